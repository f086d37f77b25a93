"""Secrets in texts: known forms, and strings that pass a battery of randomness tests (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, texts

# fixed values: forms of secrets
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Maximal runs, so asking for the least length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "random")

#: A string that could be a coded random value: a run of coding symbols with a digit, of 20 symbols with the
#: padding. A sign ``=`` is padding only where no symbol follows, so the value of name=value is a run of its own.
CODED = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?:[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
         r"|(?=[A-Za-z0-9+/_-]{16,19}+=++(?![A-Za-z0-9+/_-]))(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]{16,19}=++)")
# fixed values: alphabets by encoding
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
# the same symbols in upper case, or in groups parted by dashes or underscores (not symbols then)
ALPHABETS |= {"upper36": ALPHABETS["base36"], "parted_hex": ALPHABETS["hex"], "parted36": ALPHABETS["base36"], "parted_upper36": ALPHABETS["base36"]}
GRID = (0.001, *(k / 50 for k in range(1, 25)))
UPPER_PART = 0.5


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern in order: kind, gap before it, length, whether it counts, its text if wanted.

    The pieces between matches and the matches themselves tile the text, so running
    sums of their lengths are the places.
    """
    p = F.lit(pattern)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    rows = F.transform(F.slice(parts, F.lit(1), F.size(hits)), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("long"),
        (F.length(x["value"]) >= least).alias("ok"), (x["hit"] if kind == 3 else F.lit(None).cast("string")).alias("coded")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,long:int,ok:boolean,coded:string>>"))


def found_forms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Places of all matches: row, doc_id, kind, start, to, ok, coded; a row without matches has one of null kind."""
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    t = F.col("text")
    every = F.concat(_matches(t, ASSIGN, 0, 2, MIN_ASSIGNED), _matches(t, ACCESS, 1), _matches(t, HEX, 2), _matches(t, CODED, 3))
    flat = rows.select("row", "doc_id", F.explode_outer(every).alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (flat.withColumn("to", F.sum(F.col("gap") + F.col("long")).over(upto)).withColumn("start", F.col("to") - F.col("long"))
            .select("row", "doc_id", "kind", "start", "to", "ok", "coded"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tail(z: Column) -> Column:
    """Two-sided normal tail of |z| (a rational approximation, error below 2e-7)."""
    poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return _bound(F.abs(z) / F.lit(2.0**0.5), lambda x: _bound(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x))


def randomness(coded: DataFrame) -> DataFrame:
    """Encoding, length and probability under "symbols are uniform and independent" for strings ``coded``.

    Three tests over the symbols' numbers in the inferred alphabet: chi-squared
    uniformity (cube-root normal form), runs about the alphabet's middle, and serial
    correlation at lag one; Fisher's sum joins them. Strings of no encoding get none.
    """
    c = F.col("coded")
    digit, letters = c.rlike("[0-9]"), c.rlike("[A-Za-z]")
    bare = F.rtrim(c, F.lit("="))
    encoding = (F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & letters, "hex").when(c.rlike("^[A-Z2-7]+=*$") & c.rlike("[2-7]"), "base32")
                .when(bare.rlike("^[0-9a-z]+$") & letters, "base36").when(bare.rlike("^[0-9A-Z]+$") & letters, "upper36")
                .when(bare.rlike("^([0-9a-f_-]+|[0-9A-F_-]+)$") & digit & letters, "parted_hex").when(bare.rlike("^[0-9a-z_-]+$") & letters, "parted36")
                .when(bare.rlike("^[0-9A-Z_-]+$") & letters, "parted_upper36").when(c.rlike("^[A-Za-z0-9+/_-]+=*$") & c.rlike("[a-z]") & c.rlike("[A-Z]"), "base64"))
    one = F.col("encoding").isin("base32", "base64")
    body = F.when(one, F.translate(bare, "-_", "+/")).otherwise(F.lower(F.translate(bare, "-_", "")))
    alphabet = F.coalesce(*[F.when(F.col("encoding") == k, F.lit(v)) for k, v in ALPHABETS.items()])
    rows = coded.withColumn("encoding", encoding).filter("encoding is not null").withColumn("body", body).withColumn("alphabet", alphabet)
    rows = rows.withColumn("n", F.length("body")).withColumn("k", F.length("alphabet").cast("double")).filter("n >= 16")
    rows = rows.withColumn("x", F.transform(F.split("body", "(?!^)"), lambda s: (F.instr(F.col("alphabet"), s) - 1).cast("double")))
    counts = F.transform(F.split("alphabet", "(?!^)"), lambda s: (F.col("n") - F.length(F.replace(F.col("body"), s))).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("chi", total(F.transform(counts, lambda o: o * o)) * F.col("k") / F.col("n") - F.col("n")).withColumn("mean", total(F.col("x")) / F.col("n"))
    rows = rows.withColumn("y", F.slice("x", F.lit(2), F.col("n") - 1)).withColumn("high", total(F.transform("x", lambda v: (v >= F.col("k") / 2).cast("double"))))
    n, k, m = F.col("n"), F.col("k"), F.col("mean")
    front = F.slice("x", F.lit(1), n - 1)
    runs = 1 + total(F.zip_with(front, "y", lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double")))
    expected = 2 * F.col("high") * (n - F.col("high")) / n + 1
    spread = (F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1)
    co = total(F.zip_with(front, "y", lambda a, b: (a - m) * (b - m)))
    var = total(F.transform("x", lambda a: (a - m) * (a - m)))
    h = 2 / (9 * (k - 1))
    rows = rows.withColumn("z1", (F.cbrt(F.greatest(F.col("chi"), F.lit(0.0)) / (k - 1)) - (1 - h)) / F.sqrt(h))
    rows = rows.withColumn("expected", expected).withColumn("spread", spread).withColumn("var", var)
    rows = rows.withColumn("z2", (runs - F.col("expected")) / F.sqrt("spread")).withColumn("z3", (co / F.col("var") + 1 / n) * F.sqrt(n.cast("double")))
    rows = rows.withColumn("p1", _bound(_tail(F.col("z1")) / 2, lambda t: F.when(F.col("z1") > 0, t).otherwise(1 - t)))
    rows = rows.withColumn("p2", F.when(F.col("spread") > 0, _tail(F.col("z2"))).otherwise(0.0)).withColumn("p3", F.when(F.col("var") > 0, _tail(F.col("z3"))).otherwise(0.0))
    y = sum((-F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p1", "p2", "p3")), F.lit(0.0))
    return (rows.withColumn("surprise", y).withColumn("p", F.exp(-F.col("surprise")) * (1 + F.col("surprise") + F.col("surprise") * F.col("surprise") / 2))
            .withColumn("band", F.floor(F.log2(n.cast("double"))).cast("int")))


def thresholds(tested: DataFrame, false_share: float = 0.05) -> DataFrame:
    """Least p to accept per encoding and length band: encoding, band, least.

    Random strings have uniform p; ordinary ones gather near zero, the more so the
    longer they are. The upper half of p tells how many are random; what the part
    above a threshold holds beyond that (by two standard errors) is taken as false.
    The least threshold with at most ``false_share`` of these is used; a band where
    none will do accepts nothing. At most eight encodings times 31 bands.
    """
    above = [F.count_if(F.col("p") > t).cast("double").alias(f"a{i}") for i, t in enumerate((*GRID, UPPER_PART))]
    got = tested.groupBy("encoding", "band").agg(*above)
    upper = F.col(f"a{len(GRID)}")
    pick = []
    for i, t in enumerate(GRID):
        fair = upper / (1 - UPPER_PART) * (UPPER_PART - t)
        excess = F.greatest(F.col(f"a{i}") - upper - fair - 2 * F.sqrt(fair), F.lit(0.0))
        pick.append(F.when((upper > 0) & (excess <= false_share * F.col(f"a{i}")), F.lit(t)))
    return got.select("encoding", "band", F.coalesce(*pick).alias("least")).filter("least is not null")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = 0.05) -> DataFrame:
    """Secrets of every row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Base forms are the patterns above. The battery adds spans of kind ``random``, also
    where one lies over a base span. Places are code points, ends exclusive. Null and
    empty texts have no spans; each row is judged by itself whatever its id, so
    repeated rows and null ids keep a result each. An empty table gives none.
    """
    found = stage(found_forms(docs, id_col, text_col), "secret-forms")
    tested = stage(randomness(found.filter("kind = 3").select("row", "start", "coded")).select("row", "start", "encoding", "band", "p"), "secret-tests")
    # At most 248 rows, whatever the input.
    least = stage(thresholds(tested, false_share), "secret-thresholds")
    chosen = tested.join(F.broadcast(least), ["encoding", "band"]).filter("p > least").select("row", "start", F.lit(3).alias("kind"), F.lit(True).alias("chosen"))
    rows = found.join(chosen, ["row", "start", "kind"], "left").withColumn("ok", F.when(F.col("kind") == 3, F.coalesce("chosen", F.lit(False))).otherwise(F.col("ok")))
    span = F.struct("start", "kind", "to")
    count = lambda k: F.count_if(F.col("ok") & (F.col("kind") == k)).alias(f"n_{KINDS[k]}")
    per = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[count(k) for k in range(4)], F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("all"))
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["to"].cast("string"))), ",")
    return per.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(written(F.filter("all", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), written("all").alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
