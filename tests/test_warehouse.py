from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bazaarlens import schemas
from bazaarlens.operators import quality as DQ
from bazaarlens.operators import records as R
from bazaarlens.sources import connectors as CX
from bazaarlens.sources.warehouse import Warehouse, latest, newer_than, run_job


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path))


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, value int, version int")


def test_scan_pushes_filter_and_columns(wh, spark):
    wh.write(ids(spark, ("a", 1, 1), ("b", 2, 1)), "raw.t", "overwrite")
    df = wh.read("raw.t", F.col("value") > 1, ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,1)" in plan and "ReadSchema: struct<id:string,value:int>" in plan
    assert rows(df) == [("b",)]


def test_merge_insert_update_duplicates_and_rerun(wh, spark):
    wh.merge(ids(spark, ("test_001", 1, 1), ("test_003", 3, 1)), "t", ["id"], ["version"])
    batch = ids(spark, ("test_001", 100, 3), ("test_001", 50, 2), ("test_002", 200, 1))
    for _ in range(2):
        wh.merge(batch, "t", ["id"], ["version"])
        assert rows(wh.read("t"), "id", "value") == [("test_001", 100), ("test_002", 200), ("test_003", 3)]
    wh.merge(batch.limit(0), "t", ["id"], ["version"])
    assert wh.read("t").count() == 3


class Lost(RuntimeError):
    pass


@pytest.mark.parametrize("at", ["staging the updates", "writing the merged rows", "before the commit"])
def test_merge_that_dies_leaves_the_table(wh, spark, monkeypatch, at):
    wh.merge(ids(spark, ("a", 1, 1), ("b", 2, 1)), "t", ["id"], ["version"])
    batch, write = ids(spark, ("a", 10, 2), ("c", 3, 1)), Warehouse._write_files
    writes = []

    def failing(self, df, table, *args, **kwargs):
        done = write(self, df, table, *args, **kwargs)
        writes.append(done)
        if len(writes) == {"staging the updates": 1, "writing the merged rows": 2}.get(at):
            raise Lost
        return done

    def dying(*_):
        raise Lost
    with monkeypatch.context() as m:
        m.setattr(Warehouse, "_write_files", failing)
        if at == "before the commit":
            m.setattr(Warehouse, "_link", dying)
        with pytest.raises(Lost):
            wh.merge(batch, "t", ["id"], ["version"])
    assert wh.versions("t") == [1] and rows(wh.read("t"), "id", "value") == [("a", 1), ("b", 2)]
    wh.merge(batch, "t", ["id"], ["version"])
    assert rows(wh.read("t"), "id", "value") == [("a", 10), ("b", 2), ("c", 3)]
    assert wh.vacuum("t", older_than_hours=0) > 0 and wh.versions("t") == [2]
    assert rows(wh.read("t"), "id", "value") == [("a", 10), ("b", 2), ("c", 3)]


def test_reader_inside_a_replacement(wh, spark, monkeypatch):
    """A reader between the files and the commit, one that keeps its version, and one of an old version."""
    wh.write(ids(spark, ("a", 1, 1)), "t", "overwrite")
    pinned, seen, claim = wh.read("t"), [], Warehouse._claim

    def looking(self, *args):
        seen.append((self.exists("t"), rows(self.read("t"), "id")))
        return claim(self, *args)
    monkeypatch.setattr(Warehouse, "_claim", looking)
    wh.write(ids(spark, ("b", 2, 1)), "t", "overwrite")
    wh.merge(ids(spark, ("c", 3, 1)), "t", ["id"], ["version"])
    assert seen == [(True, [("a",)]), (True, [("b",)])]
    assert rows(wh.read("t"), "id") == [("b",), ("c",)]
    assert rows(pinned, "id") == [("a",)] and rows(wh.read("t", version=2), "id") == [("b",)]
    assert rows(wh.history("t"), "version", "operation") == [(1, "overwrite"), (2, "overwrite"), (3, "merge")]
    with pytest.raises(ValueError):
        wh.read("t", version=9)


@pytest.mark.parametrize("partitioned", [False, True])
def test_second_writer_in_between_loses_nothing(wh, spark, monkeypatch, partitioned):
    """Another writer commits after the merged rows are written: the same partition, and another one."""
    by = ["value"] if partitioned else []
    wh.write(ids(spark, ("a", 1, 1), ("b", 2, 1)), "t", "overwrite", by)
    claim, writes, write = Warehouse._claim, [], Warehouse._write_files
    others = [ids(spark, ("c", 1, 1)), ids(spark, ("d", 3, 1))]

    def later(self, *args):
        if others:
            self.merge(others.pop(), "t", ["id"], ["version"])
        return claim(self, *args)

    def counted(self, df, table, by, **options):
        writes.append(1)
        return write(self, df, table, by, **options)
    monkeypatch.setattr(Warehouse, "_claim", later)
    monkeypatch.setattr(Warehouse, "_write_files", counted)
    wh.merge(ids(spark, ("a", 1, 9), ("e", 1, 1)), "t", ["id"], ["version"])
    assert rows(wh.read("t"), "id", "value", "version") == [("a", 1, 9), ("b", 2, 1), ("c", 1, 1), ("d", 3, 1), ("e", 1, 1)]
    assert wh.versions("t") == [1, 2, 3, 4]


def test_writers_at_once(wh, spark):
    from concurrent.futures import ThreadPoolExecutor
    wh.write(ids(spark, ("a", 0, 0)), "t", "overwrite")
    jobs = [lambda i=i: wh.merge(ids(spark, (f"m{i}", i, 1), ("a", i, i)), "t", ["id"], ["version"]) for i in range(3)]
    jobs += [lambda i=i: wh.write(ids(spark, (f"w{i}", i, 1)), "t", "append") for i in range(3)]
    with ThreadPoolExecutor(6) as pool:
        done = [f.result() for f in [pool.submit(j) for j in jobs]]
    assert sorted(done) == [2, 3, 4, 5, 6, 7]
    assert rows(wh.read("t").filter("id <> 'a'"), "id") == [("m0",), ("m1",), ("m2",), ("w0",), ("w1",), ("w2",)]
    assert wh.read("t").filter("id = 'a'").count() == 1


def test_rename_never_replaces(wh, spark):
    """The commit by rename, which other file systems than local disks use."""
    from types import MethodType
    wh.write(ids(spark, ("a", 1, 1)), "t", "overwrite")
    object.__setattr__(wh, "_link", MethodType(Warehouse._rename, wh))
    assert not wh._claim("t", 1, "{}") and wh._claim("t", 2, wh.snapshot("t").to_json())
    assert wh.versions("t") == [1, 2] and rows(wh.read("t"), "id") == [("a",)]


def test_null_partitions_and_keys_are_kept(wh, spark):
    schema = "id int, day date, v int"
    wh.merge(spark.createDataFrame([(1, None, 1), (2, None, 1), (None, None, 1), (3, date(2024, 1, 1), 1)], schema), "n", ["id"], ["v"], ["day"])
    wh.merge(spark.createDataFrame([(9, None, 2), (2, None, 5), (None, None, 7)], schema), "n", ["id"], ["v"], ["day"])
    assert rows(wh.read("n"), "id", "v") == [(1, 1), (2, 5), (3, 1), (9, 2), (None, 7)]
    wh.merge(spark.createDataFrame([], schema), "n", ["id"], ["v"])
    wh.merge(spark.createDataFrame([], schema), "empty", ["id"], ["v"], ["day"])
    assert wh.read("n").count() == 5 and wh.read("empty").count() == 0 and wh.read("empty").columns == ["id", "day", "v"]


def test_schema_of_a_table(wh, spark):
    wh.write(ids(spark, ("a", 1, 1)), "s", "append")
    wh.write(ids(spark, ("b", 1, 1)).withColumn("more", F.lit(5)), "s", "append")
    assert rows(wh.read("s"), "id", "more") == [("a", None), ("b", 5)]
    wh.merge(ids(spark, ("a", 7, 2)), "s", ["id"], ["version"])
    assert rows(wh.read("s"), "id", "value", "more") == [("a", 7, None), ("b", 1, 5)]
    with pytest.raises(ValueError, match="value"):
        wh.write(ids(spark, ("a", 1, 1)).withColumn("value", F.lit("x")), "s", "append")
    with pytest.raises(ValueError, match="partitioned"):
        wh.write(ids(spark, ("a", 1, 1)), "s", "append", ["version"])
    ids(spark, ("p", 1, 1)).write.parquet(wh.path("plain"))
    assert wh.exists("plain") and rows(wh.read("plain"), "id") == [("p",)]
    with pytest.raises(ValueError, match="plain"):
        wh.write(ids(spark, ("a", 1, 1)), "plain")
    with pytest.raises(ValueError, match="no table"):
        wh.read("nowhere")


def test_shared_folder_is_required_off_local():
    from types import SimpleNamespace

    from bazaarlens.session import shared_folder
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *a: None))
        with pytest.raises(ValueError):
            shared_folder(session)


def test_partitioned_merge_leaves_other_partitions_alone(wh, spark):
    base = spark.createDataFrame([(i, date(2024, 1, 1 + i % 3), 0) for i in range(9)], "id int, day date, v int")
    wh.write(base, "p", "overwrite", ["day"])
    before = wh.snapshot("p").parts
    wh.merge(spark.createDataFrame([(1, date(2024, 1, 2), 9), (50, date(2024, 1, 2), 9)], "id int, day date, v int"), "p", ["id"], ["v"], ["day"])
    after = wh.snapshot("p").parts
    assert sorted(before) == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"]
    assert [d for d in before if before[d] != after[d]] == ["day=2024-01-02"]
    assert rows(wh.read("p").filter("v = 9"), "id") == [(1,), (50,)] and wh.read("p").count() == 10


def test_incremental_merges_equal_full_rebuild(wh, spark):
    data = [(f"k{i % 7}", i, i) for i in range(40)]
    for s in range(0, 40, 10):
        wh.merge(ids(spark, *data[s:s + 10]), "inc", ["id"], ["version"])
    assert rows(wh.read("inc")) == rows(latest(ids(spark, *data), ["id"], ["version"]), "id", "value", "version")


def test_partition_overwrite_keeps_other_days(wh, spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, day string")
    wh.write(df, "o", "overwrite", ["day"])
    wh.write(spark.createDataFrame([(7, "2024-01-02")], "v int, day string"), "o", "overwrite_partitions", ["day"])
    assert rows(wh.read("o"), "v") == [(1,), (7,)]
    with pytest.raises(ValueError):
        wh.write(df, "o", "merge")


def test_watermark(wh, spark):
    assert wh.watermark("none", "version") is None
    wh.write(ids(spark, ("a", 1, 4)), "w", "overwrite")
    assert rows(newer_than(ids(spark, ("b", 1, 4), ("c", 1, 5)), "version", wh.watermark("w", "version")), "id") == [("c",)]
    assert newer_than(ids(spark, ("b", 1, 4)), "version", None).count() == 1


def test_run_job_counts_and_audit(wh, spark):
    audit = lambda run: wh.log_run("job", "2024-01-15", run.status, run.extracted, run.transformed, run.loaded, run.failed_stage, run.error)
    src = ids(spark, ("a", 1, 1), ("b", 2, 1), ("c", 3, 1))
    run = run_job(lambda: src, [lambda d: d.filter("value > 1")], lambda d: wh.write(d, "out", "overwrite"), audit)
    assert (run.status, run.extracted, run.loaded) == ("success", 3, 2)
    empty = run_job(lambda: src.limit(0), [], lambda d: wh.write(d, "out2", "overwrite"), audit)
    assert (empty.status, empty.loaded) == ("success", 0)
    with pytest.raises(RuntimeError):
        run_job(lambda: src, [lambda d: (_ for _ in ()).throw(RuntimeError("boom"))], lambda d: None, audit)
    assert rows(wh.read("audit.job_runs"), "status", "rows_extracted", "failed_stage") == [("failed", None, "transform"), ("success", 0, None), ("success", 3, None)]


def test_files_round_trip(spark, tmp_path):
    df = ids(spark, ("a", 1, 1), ("b", 2, 2))
    for fmt in ("parquet", "orc", "json"):
        CX.to_files(df, str(tmp_path / fmt), fmt, "overwrite", ["version"])
        assert rows(CX.from_files(spark, str(tmp_path / fmt), fmt, "id string, value int, version int"), "id", "value") == [("a", 1), ("b", 2)]
    CX.to_csv(df, str(tmp_path / "csv"))
    assert rows(CX.from_files(spark, str(tmp_path / "csv"), "csv", "id string, value int, version int", header="true"), "id") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        CX.from_files(spark, str(tmp_path / "csv"), "csv")


def test_fan_out_counts_all_sinks(spark, tmp_path):
    df = ids(spark, ("a", 1, 1), ("b", 2, 2))
    assert CX.fan_out(df, [lambda d: d.write.parquet(str(tmp_path / "x")), lambda d: d.write.json(str(tmp_path / "y"))]) == 4


def test_contracts():
    assert [len(s.fields) for s in (schemas.RAW_ORDERS, schemas.RAW_ORDER_ITEMS, schemas.FACT_ORDERS, schemas.AGG_DAILY_GMV)] == [25, 16, 32, 17]


def test_validate_and_conform(spark):
    df = ids(spark, ("a", 1, 1), (None, 2, 1))
    assert DQ.validate(df, ["id"]) and not DQ.validate(df.limit(0), ["id"])
    with pytest.raises(DQ.ContractError, match="missing"):
        DQ.validate(df, ["nope"])
    with pytest.raises(DQ.ContractError, match="'id': 1"):
        DQ.validate(df, ["id"], ["id", "value"])
    c = schemas.contract("value:d10 id:string")
    assert DQ.conform(df, c).schema.simpleString() == "struct<value:decimal(10,2),id:string>"
    assert DQ.schema_diff(df, c) == {"missing": [], "extra": ["version"], "type": ["value"]}


def test_empty_tables_count_zero(spark):
    df = ids(spark, ("a", 1, 1)).limit(0)
    assert rows(DQ.null_counts(df, ["id"])) == [("id", 0)]
    assert rows(DQ.rule_counts(df, {"r": F.col("value") > 0})) == [("r", 0)]


def test_rename_last_wins_and_drop(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert R.map_columns(df, {"a": "x", "b": "x"}).first().asDict() == {"x": 2, "c": 3}
    assert R.map_columns(df, {"a": "x"}, drop_unmapped=True).columns == ["x"]


def test_casts_flag_failures(spark):
    df = spark.createDataFrame([("5", "2024-01-15T10:30:00Z"), ("x", "soon"), (None, None)], "n string, t string")
    got = [tuple(r) for r in R.cast_columns(df, {"n": "int", "t": "datetime"}).select("n", "n_cast_error", "t", "t_cast_error").collect()]
    assert got == [(5, False, datetime(2024, 1, 15, 10, 30), False), (None, True, None, True), (None, False, None, False)]


def test_aggregate_defaults_and_unknown(spark):
    df = spark.createDataFrame([("g", None)], "k string, v int")
    out = R.aggregate(df, ["k"], {"s": ("v", "sum"), "m": ("v", "mean"), "lo": ("v", "min"), "n": ("v", "count")}).first()
    assert (out.s, out.m, out.lo, out.n) == (0, 0.0, None, 0)
    with pytest.raises(ValueError):
        R.aggregate(df, ["k"], {"s": ("v", "median")})


def test_lookup_distinguishes_matched_null(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    table = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(R.look_up(df, table, "k", "k", "v", "out", "dflt"), "k", "out") == [(1, "a"), (2, None), (3, "dflt"), (None, "dflt")]
