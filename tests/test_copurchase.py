"""Co-purchase neighbours against all pairs, with baskets too wide to list."""

import numpy as np
import pytest
from conftest import plan

from bazaarlens.operators import copurchase as CP
from bazaarlens.operators import neighbours, packed, scale
from bazaarlens.operators.neighbours import Visits


def brute(data, n):
    orders = {}
    for o, i in data:
        orders.setdefault(i, set()).add(o)
    out = {}
    for a, mine in orders.items():
        scored = sorted((-len(mine & other) / np.sqrt(float(len(mine)) * len(other)), b, len(mine & other)) for b, other in orders.items() if b != a and mine & other)
        out[a] = [(b, t) for _, b, t in scored[:n]]
    return {a: v for a, v in out.items() if v}


def result(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["other_id"], r["together"]))
    return {k: [(b, t) for _, b, t in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("wide,block_rows", [(20, 30), (10**9, 1024), (0, 50)])
def test_equal_to_all_pairs_at_every_width(spark, wide, block_rows):
    rng = np.random.default_rng(6)
    data = [(o, int(i)) for o in range(80) for i in rng.choice(150, size=4, replace=False)] + [(100, i) for i in range(120)] + [(101, i) for i in range(40, 260)] + [(102, i) for i in range(0, 250, 3)]
    b = spark.createDataFrame(data + data[:50], "order_id long, item_id long").repartition(4)
    assert result(CP.item_item(b, b, 5, wide, block_rows)) == brute(data, 5)
    some = b.filter("item_id % 7 = 0")
    assert result(CP.item_item(b, some, 3, wide, block_rows)) == {k: v for k, v in brute(data, 3).items() if k % 7 == 0}


def test_a_basket_of_twenty_thousand_lines_has_few_cells(spark):
    """Its 400 million pairs are never listed: most items share nothing else, so the first block settles them."""
    data = [(1, i) for i in range(20_000)] + [(2 + i % 50, i) for i in range(500)]
    b = spark.createDataFrame(data, "order_id long, item_id long")
    visits = Visits()
    got = result(CP.item_item(b, b, 3, visits=visits))
    assert len(got) == 20_000 and sum(visits.rounds) < 5 * 20_000 and visits.skipped > 0.7
    assert got[19_999] == [(500, 1), (501, 1), (502, 1)] and got[500] == [(501, 1), (502, 1), (503, 1)]
    assert got[0] == [(50, 2), (100, 2), (150, 2)]


def test_pairs_are_counted_once_and_not_joined_with_frequencies(spark):
    rng = np.random.default_rng(9)
    data = [(o, int(i)) for o in range(60) for i in rng.choice(50, size=4, replace=False)]
    b = spark.createDataFrame([*data, *data[:20], (None, 1), (1, None)], "order_id long, item_id long")
    out = CP.item_item(b, b, 5)
    got = result(out)
    freq = {}
    for _, i in {*data, (None, 1)}:  # an order without id counts for its items
        freq[i] = freq.get(i, 0) + 1
    orders = {}
    for o, i in data:
        orders.setdefault(i, set()).add(o)
    want = {a: [(j, t) for _, j, t in sorted((-len(x & y) / np.sqrt(float(freq[a]) * freq[j]), j, len(x & y)) for j, y in orders.items() if j != a and x & y)[:5]] for a, x in orders.items()}
    assert got == want
    text = plan(out)
    assert text.index("Join") > text.index("together")  # every join stands below the count
    above = text[: text.index("Join")]
    assert "item_id" in above and above.count("Exchange") <= 2


def test_tasks_follow_the_rows_and_results_stay(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 40)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 200)
    rng = np.random.default_rng(16)
    # Item 0 is in every small basket, null ids are no order's and no item's.
    data = [(o, int(i)) for o in range(90) for i in {0, *rng.choice(60, size=4, replace=False)}] + [(100 + k, i) for k in range(3) for i in range(k, 70, 1 + k)]
    b = spark.createDataFrame([*data, *data[:20], (1, None), (None, None)], "order_id long, item_id long")
    out = CP.item_item(b, b, 3, 8, 30)
    assert "REPARTITION_BY_NUM" in plan(out)
    assert result(out) == brute(data, 3)
    small = [(o, i) for o, i in data if o < 100]
    s = spark.createDataFrame(small, "order_id long, item_id long")
    out = CP.item_item(s, s, 3, 8)
    assert "REPARTITION_BY_NUM" in plan(out) and result(out) == brute(small, 3)
    assert result(CP.item_item(b, b.filter("item_id % 7 = 0"), 3, 8, 30)) == {k: v for k, v in brute(data, 3).items() if k % 7 == 0}


def test_pairs_of_many_lines_travel_as_packed_lists(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    rng = np.random.default_rng(22)
    # Ids of both signs and any size, null ids, an order without id that counts for its items, lines that come twice.
    ids = np.append(rng.integers(-(2**62), 2**62, 100), np.arange(100))
    data = [(o - 200, int(i)) for o in range(400) for i in rng.choice(ids, size=1 + o % 7, replace=False)]
    lone = [(None, i) for _, i in data[:5]]
    b = spark.createDataFrame([*data, *data[:300], *lone, *lone, (1, None), (None, None)], "order_id long, item_id long").repartition(6)
    orders = {}
    for o, i in {*data, *lone}:
        orders.setdefault(i, set()).add(o)
    out = CP.item_item(b, b, 4)
    text = plan(out)
    # Before, rows of pairs were dealt three times: by both items, by an item and a part of its pairs, and by the item.
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(task" in text
    want = {}
    for a, x in orders.items():
        near = sorted((-len((x & y) - {None}) / np.sqrt(float(len(x)) * len(y)), j, len((x & y) - {None})) for j, y in orders.items() if j != a and (x & y) - {None})[:4]
        want |= {a: [(j, t) for _, j, t in near]} if near else {}
    assert result(out) == want
    score = {(r["item_id"], r["other_id"]): r["score"] for r in out.collect()}
    assert all(score[a, j] == t / np.sqrt(float(len(orders[a])) * len(orders[j])) for a, v in want.items() for j, t in v)
    narrow = spark.createDataFrame(data, "order_id int, item_id long").filter("item_id BETWEEN 0 AND 99").selectExpr("order_id", "cast(item_id as int) item_id")
    small = [(o, i) for o, i in data if 0 <= i < 100]
    out = CP.item_item(narrow, narrow, 4)
    assert dict(out.dtypes) == {"item_id": "int", "other_id": "int", "together": "bigint", "score": "double", "rank": "int"} and result(out) == brute(small, 4)


def test_a_packed_pair_takes_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK", 1 << 14)
    rng = np.random.default_rng(5)
    data = [(o, int(i)) for o in range(10_000) for i in rng.integers(0, 7_000_000, 5)]
    lines = spark.createDataFrame(data, "order_id long, item_id long")
    groups = packed.grouped(packed.counted(lines, len(data), 4).selectExpr("*", "false held"), 4, [])
    rows = groups.mapInArrow(packed._packer(16, []), packed.PACKED)
    size = " + ".join(f"length({c})" for c in ("item", "f", "many", "other", "g"))
    used = rows.selectExpr("sum(pairs) pairs", "count(*) rows", f"sum({size}) bytes").first()
    assert used["pairs"] > 199_000 and used["bytes"] + 100 * used["rows"] < 6 * used["pairs"]


@pytest.mark.parametrize("wide,every", [(256, False), (8, False), (8, True)])
def test_busy_items_and_orders_and_wide_baskets_among_many_lines(spark, monkeypatch, wide, every):
    """Items 0 and 1 stand in most orders, orders 900 and 901 hold many items (``every``: all of them)."""
    monkeypatch.setattr(scale, "TASK_ROWS", 60)
    monkeypatch.setattr(packed, "BUSY_LINES", 40)
    monkeypatch.setattr(packed, "BUSY", 64)
    monkeypatch.setattr(packed, "HELD", 50)
    rng = np.random.default_rng(23)
    data = [(o, int(i)) for o in range(200) for i in {0, o % 3, *rng.choice(120, size=1 + o % 6, replace=False)}]
    data += [(900 + k, i) for k in range(2) for i in range(0, 120, 1 if every else 2 + k)]
    b = spark.createDataFrame([*data, *data[:90], (1, None), (None, None)], "order_id long, item_id long").repartition(5)
    assert 0 in packed.busy(b, "item_id", len(data), 40) and set(packed.busy(b, "order_id", len(data), 35)) == {900, 901}
    assert result(CP.item_item(b, b, 5, wide, 30)) == brute(data, 5)
