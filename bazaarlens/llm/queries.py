"""Registered queries of this package and their check SQL."""

from __future__ import annotations

from .chats import OP13_SQL, op13_chat_trees
from .exact_dedup import OP8_SQL, op8_content_sort
from .fim import OP12_SQL, op12_fill_in_middle
from .interactions import OP11_SQL, op11_filter_interactions
from .lm import op9_mixing_scores
from .near_dedup import op3_near_duplicates
from .packing import op10_packed_sequences
from .pieces import op7_piece_round_trip
from .quality import op6_quality_scores
from .rules import op4_rule_forest
from .secrets import op2_secret_scan
from .suffix_dedup import op1_repeat_removal
from .warc import OP5_SQL, op5_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_repeat_removal, op2_secret_scan, op3_near_duplicates, op4_rule_forest, op5_warc_round_trip, op6_quality_scores, op7_piece_round_trip, op8_content_sort, op9_mixing_scores, op10_packed_sequences,
                                    op11_filter_interactions, op12_fill_in_middle, op13_chat_trees)}
ORACLE = {"op5_warc_round_trip": OP5_SQL, "op8_content_sort": OP8_SQL, "op11_filter_interactions": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_chat_trees": OP13_SQL}
