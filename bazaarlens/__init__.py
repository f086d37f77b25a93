"""Commerce analytics as PySpark DataFrame operators.

Every operator takes DataFrames (plus explicit parameters such as the run
date) and returns a DataFrame. Most only plan. The sinks, and operators that read
an intermediate result several times or in rounds (searches, usage limits), write
it in the shared folder of :mod:`bazaarlens.session` first.
"""
