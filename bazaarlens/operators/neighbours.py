"""Exact top-n search over vectors, of all pairs: by products of large cells, or by a metric index.

``nearest`` compares all pairs of up to ``DENSE_ITEMS`` items in cells of matrices, where a product in single precision bounds every score and
only pairs that can be among the best n are scored. Its work is that of all pairs; what it holds is a pair of cells.

In the index blocks are visited best bound first. Items are grouped around pivots by direction, each group is cut into blocks along its angle to the
pivot (cosine) or along the norm (inner product), and a block is known by a few numbers: ranges of angle, norm and
price, and which categories it may hold. From these an upper bound of every score in the block
follows, by the triangle inequality on the sphere and by Cauchy-Schwarz. A source first meets the blocks of its
best bounds, then those among four times as many that its n-th score so far does not rule out, and is done when
no bound reaches that score. Results are those of all pairs; what is skipped is proven to be worse.

Sizes: at most ``PIVOTS`` directions and about ``BLOCKS`` blocks whatever the number of items, so the table of
blocks that reaches every task has a fixed bound; a block's rows grow beyond ``block_rows`` only with more than
``BLOCKS * block_rows`` items. A cell (block, chunk of sources) is one cogroup. Sources that all want one
block are cut into chunks of ``block_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .scale import TASK_ROWS, dealt
from .similarity import BLOCK_ROWS, PLACES, Score, best_of_cell, block_top_n

PIVOTS, BLOCKS, BANDS = 256, 32_768, 64
SMALL, DENSE, DENSE_ITEMS = 4, 16, 1 << 21
TILE, HEAD, PAIRS, PLACES_HELD = (512, 8192), 1024, 1 << 16, 32
FIRST, FACTOR = 2, 4
SLACK = 1e-6


@dataclass(frozen=True)
class Bounds:
    """What of a score can be bounded per block: ``weight`` times the vectors' product, plus gains.

    ``unit``: cosine, else inner product. ``same``: (column, gain) where both sides are equal. ``near``: (column, gain) of
    ``gain * exp(-d**2 / 2)``. ``must``: columns that have to be equal where the source has a value.
    ``between``: item column and the source's lower and upper limit of it; ``strict``: a missing value lies outside of any limit.
    """

    vector: str = "embedding"
    source_vector: str = "embedding"
    unit: bool = True
    weight: float = 1.0
    same: tuple[tuple[str, float], ...] = ()
    near: tuple[str, float] | None = None
    must: tuple[str, ...] = ()
    between: tuple[str, str, str] | None = None
    strict: bool = False


@dataclass
class Visits:
    """Cells of all sources with all blocks, and how many of them were scored, by round."""

    possible: int = 0
    rounds: list[int] = field(default_factory=list)

    @property
    def skipped(self) -> float:
        return 1 - sum(self.rounds) / max(self.possible, 1)


def _rows(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; a missing vector is a zero row."""
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            m[i] = v
    return m


def _unit(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and norms."""
    m = _rows(vectors, width)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm == 0, 1, norm)[:, None], norm


def _angles(unit: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of every row to every pivot; a zero row stands at a right angle to all."""
    out = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    out[norm == 0] = np.pi / 2
    return out


def _bits(column: str) -> Column:
    """One bit of 63 per value, none for null: a block's mask tells which values it may hold."""
    return F.coalesce(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 63) AS int))"), F.lit(0).cast("bigint")) * F.col(column).isNotNull().cast("bigint")


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upper_bounds(rows: pd.DataFrame, blocks: pd.DataFrame, b: Bounds, pivots: np.ndarray) -> np.ndarray:
    """Upper bound of the score of every source row with any item of every block; -inf where none can match."""
    unit, norm = _unit(rows[b.source_vector], pivots.shape[1])
    angle = _angles(unit, norm, pivots)[:, blocks["_pivot"].to_numpy()]
    apart = np.maximum(0, np.maximum(angle - blocks["hi"].to_numpy(), blocks["lo"].to_numpy() - angle) - SLACK)
    cosine = np.cos(np.minimum(apart, np.pi))
    length = np.where(cosine >= 0, blocks["nhi"].to_numpy(), blocks["nlo"].to_numpy())
    out = b.weight * cosine * length * (np.where(norm > 0, 1.0, 0.0) if b.unit else norm)[:, None]
    may_hold = lambda name: (rows[f"_bits_{name}"].to_numpy(dtype=np.int64)[:, None] & blocks[f"bits_{name}"].to_numpy(dtype=np.int64)) != 0
    for name, gain in b.same:
        out += gain * may_hold(name)
    if b.near:
        name, gain = b.near
        at = rows[name].to_numpy(dtype=float)[:, None]
        gap = np.maximum(0, np.maximum(at - blocks[f"max_{name}"].to_numpy(dtype=float), blocks[f"min_{name}"].to_numpy(dtype=float) - at))
        out += gain * np.exp(-(np.nan_to_num(gap) ** 2) / 2)
    out += SLACK * (1 + np.abs(out))
    for name in b.must:
        out[rows[name].notna().to_numpy()[:, None] & ~may_hold(name)] = -np.inf
    if b.between:
        name, low, high = b.between
        with np.errstate(invalid="ignore"):
            out[rows[low].to_numpy(dtype=float)[:, None] > blocks[f"max_{name}"].to_numpy(dtype=float)] = -np.inf
            out[rows[high].to_numpy(dtype=float)[:, None] < blocks[f"min_{name}"].to_numpy(dtype=float)] = -np.inf
    return out


class Search:
    """Blocks of items (``items`` with a column ``_block``), a row of numbers for each, and an upper bound of a source's scores in them.

    Where ``blocks`` has a column ``first``, it is the smallest (numeric) id of the block, and bounds are exact.
    """

    def __init__(self, items: DataFrame, blocks: pd.DataFrame, bound: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], key: str, block_rows: int):
        self.items, self.blocks, self.bound, self.key, self.block_rows = items, blocks, bound, key, block_rows

    def top_n(self, sources: DataFrame, score: Score, n: int, source_key: str = "source_id", visits: Visits | None = None, start: DataFrame | None = None) -> DataFrame:
        """(source, item, score, rank): the best ``n`` items of every source, ties by item.

        A source may ask for its own number in a column ``need``. ``score`` gives the matrix of a cell, -inf where a pair
        does not count; it must not exceed what ``bound`` says. ``start``: scored pairs known already, which
        count where they are better than what a cell says of the same pair.
        """
        key, n_blocks = self.key, len(self.blocks)
        visits = visits if visits is not None else Visits()
        sources = sources.withColumn("_need", F.col("need").cast("int") if "need" in sources.columns else F.lit(n))
        kinds = {f.name: f.dataType.simpleString() for f in [*sources.schema, *self.items.schema]}
        count, asked = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("_need"), F.lit(0))).first()
        chunks = max(1, ceil(count / self.block_rows))
        visits.possible += count * n_blocks
        sources = _stage(sources.withColumn("_chunk", F.pmod(F.xxhash64(source_key), F.lit(chunks)).cast("int")), "index-sources")
        found = f"{source_key} {kinds[source_key]}, {key} {kinds[key]}, score double"
        best = sources.sparkSession.createDataFrame([], found + ", rank int")
        self._twice = start is not None
        if start is not None:
            best = _stage(self._kept(start.select(source_key, key, "score"), sources, source_key, asked), "index-best")
        visited = None
        upto = min(FIRST, n_blocks)
        while n_blocks:
            wanted = self._wanted(sources, best, source_key, upto)
            wanted = _stage(wanted if visited is None else wanted.join(visited, [source_key, "_block"], "left_anti"), "index-visits")
            number = wanted.count()
            if not number:
                if upto == n_blocks:
                    break
                upto = n_blocks
                continue
            visits.rounds.append(number)
            visited = wanted.select(source_key, "_block") if visited is None else visited.unionByName(wanted.select(source_key, "_block"))
            upto = min(upto * FACTOR, n_blocks)
            rows = wanted.join(sources.drop("_chunk"), source_key)
            # Fresh attribute ids: both sides of the cogroup come from the visits.
            cells = wanted.select(F.col("_block").alias("_block"), F.col("_chunk").alias("_chunk")).distinct()
            met = cells.join(self.items, "_block")

            def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                return best_of_cell(left, right, score, "_need", source_key, key)

            tasks = ceil((number + cells.count() * self.block_rows) / TASK_ROWS)
            if tasks > sources.sparkSession.sparkContext.defaultParallelism:
                rows, met = (side.repartition(tasks, "_block", "_chunk") for side in (rows, met))
            new = rows.groupBy("_block", "_chunk").cogroup(met.groupBy("_block", "_chunk")).applyInPandas(cell, found)
            best = _stage(self._kept(best.drop("rank").unionByName(new), sources, source_key, 2 * asked), "index-best")
        return best

    def _kept(self, best: DataFrame, sources: DataFrame, source_key: str, rows: int) -> DataFrame:
        order = Window.partitionBy(source_key).orderBy(F.desc("score"), F.asc(self.key))
        best = dealt(best, rows, source_key)
        if self._twice:
            best = best.groupBy(source_key, self.key).agg(F.max("score").alias("score"))
        ranked = best.join(sources.select(source_key, "_need"), source_key).withColumn("rank", F.row_number().over(order))
        return ranked.filter(F.col("rank") <= F.col("_need")).drop("_need")

    def _wanted(self, sources: DataFrame, best: DataFrame, source_key: str, upto: int) -> DataFrame:
        """(source, chunk, block): of the ``upto`` blocks of a source's best bounds, those that its n-th score does not rule out."""
        kind = sources.schema[source_key].dataType.simpleString()
        # The row of a source's n-th rank is what a block has to reach; a source without one has fewer so far.
        last = best.select(F.col(source_key).alias("_source"), F.col("rank").alias("_rank"), F.col("score").alias("_least"), F.col(self.key).alias("_last"))
        bound_of, blocks = self.bound, self.blocks
        step = max(1, 2_000_000 // max(len(blocks), 1))

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), step):
                    rows = batch.iloc[at : at + step]
                    bound = bound_of(rows, blocks)
                    enough = rows["_least"].notna().to_numpy()
                    least = np.where(enough, rows["_least"].to_numpy(dtype=float), -np.inf)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, :upto]
                    own = np.take_along_axis(bound, order, axis=1)
                    reach = own >= least[:, None]
                    if "first" in blocks:  # items of a block that only ties the n-th score come after it when all of their ids do
                        last = rows["_last"].to_numpy(dtype=float)[:, None]
                        reach &= (own > least[:, None]) | ~enough[:, None] | (blocks["first"].to_numpy(dtype=float)[order] < last)
                    row, col = np.nonzero(reach & (own > -np.inf) & (rows["_need"].to_numpy() > 0)[:, None])
                    yield pd.DataFrame({source_key: rows[source_key].to_numpy()[row], "_chunk": rows["_chunk"].to_numpy()[row], "_block": order[row, col].astype("int32")})

        return sources.join(last, (F.col(source_key) == F.col("_source")) & (F.col("_need") == F.col("_rank")), "left").drop("_source", "_rank").mapInPandas(visit, f"{source_key} {kind}, _chunk int, _block int")


class Index(Search):
    """Blocks of an item table for one ``Bounds``; ``top_n`` may be asked again with other sources."""

    def __init__(self, items: DataFrame, bounds: Bounds, item_key: str = "item_id", block_rows: int = BLOCK_ROWS):
        self.bounds, self.key = bounds, item_key
        n = items.count()
        self.block_rows = max(block_rows, ceil(n / BLOCKS))
        first = items.filter(F.col(bounds.vector).isNotNull()).select(bounds.vector, item_key).orderBy(F.xxhash64(item_key), item_key).limit(min(PIVOTS, max(1, ceil(n / self.block_rows)))).toPandas()
        self.width = len(first[bounds.vector].iloc[0]) if len(first) else 1
        self.pivots = _unit(first[bounds.vector], self.width)[0] if len(first) else np.zeros((1, 1))
        placed = _stage(self._placed(items), "index-items")
        super().__init__(*self._cut(placed), partial(upper_bounds, b=bounds, pivots=self.pivots), item_key, self.block_rows)

    def _placed(self, items: DataFrame) -> DataFrame:
        """Items with their nearest pivot, the angle to it and the norm."""
        bounds, pivots, width = self.bounds, self.pivots, self.width

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                unit, norm = _unit(rows[bounds.vector], width)
                angle = _angles(unit, norm, pivots)
                near = angle.argmin(axis=1)
                yield rows.assign(_pivot=near.astype("int32"), _angle=angle[np.arange(len(rows)), near], _norm=np.where(norm > 0, 1.0, 0.0) if bounds.unit else norm)

        extra = "_pivot int, _angle double, _norm double"
        spec = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema], extra])
        return items.mapInPandas(place, spec)

    def _cut(self, placed: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
        """Blocks of about ``block_rows``: neighbouring bands of a pivot together, a band of more rows by hash."""
        band = F.floor(F.col("_angle") * (BANDS / np.pi)) if self.bounds.unit else F.floor(F.log2(F.greatest("_norm", F.lit(1e-12))) * 8)
        placed = placed.withColumn("_band", band.cast("int"))
        # Pivots and bands are few whatever the items are, so this table is small.
        sizes = placed.groupBy("_pivot", "_band").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_pivot").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1))
        cuts = sizes.select(F.col("_pivot").alias("_p"), F.col("_band").alias("_b"), F.floor(F.coalesce(before, F.lit(0)) / self.block_rows).alias("_group"),
                            F.ceil(F.col("_n") / self.block_rows).alias("_parts"))
        cells = placed.join(cuts, (F.col("_pivot") == F.col("_p")) & (F.col("_band") == F.col("_b"))).withColumn(
            "_cell", F.struct("_pivot", "_group", F.when(F.col("_parts") > 1, F.col("_band")).alias("_wide"), F.pmod(F.xxhash64(self.key), F.col("_parts")).alias("_part")))
        b = self.bounds
        stats = {"lo": F.min("_angle"), "hi": F.max("_angle"), "nlo": F.min("_norm"), "nhi": F.max("_norm"), "size": F.count(F.lit(1))}
        for name in {c for c, _ in b.same} | set(b.must):
            stats[f"bits_{name}"] = F.bit_or(_bits(name))
        for name in ({b.near[0]} if b.near else set()) | ({b.between[0]} if b.between else set()):
            stats |= {f"min_{name}": F.min(F.col(name).cast("double")), f"max_{name}": F.max(F.col(name).cast("double"))}
        blocks = cells.groupBy("_cell").agg(*[v.alias(k) for k, v in stats.items()]).select("_cell.*", *stats).toPandas()
        blocks = blocks.sort_values(["_pivot", "_group", "_wide", "_part"]).reset_index(drop=True)
        numbers = placed.sparkSession.createDataFrame([(int(r[0]), int(r[1]), None if pd.isna(r[2]) else int(r[2]), int(r[3]), i) for i, r in enumerate(blocks[["_pivot", "_group", "_wide", "_part"]].itertuples(index=False))],
                                                      "p int, g bigint, w int, q bigint, _block int")
        named = cells.join(numbers, (F.col("_cell._pivot") == F.col("p")) & (F.col("_cell._group") == F.col("g")) & F.col("_cell._wide").eqNullSafe(F.col("w")) & (F.col("_cell._part") == F.col("q")))
        plain = [c for c in placed.columns if not c.startswith("_")]
        return _stage(named.select("_block", *plain), "index-blocks"), blocks

    def top_n(self, sources: DataFrame, score: Score, n: int, source_key: str = "source_id", visits: Visits | None = None, start: DataFrame | None = None) -> DataFrame:
        for name in {c for c, _ in self.bounds.same} | set(self.bounds.must):
            sources = sources.withColumn(f"_bits_{name}", _bits(name))
        return super().top_n(sources, score, n, source_key, visits, start)


class _Cell:
    """The pairs of one cell: scores as ``Bounds`` gives them, and an upper bound of all of them by one product in single precision.

    Equal values gain (or others are shut out) by further columns of the product, one per place of ``PLACES_HELD``; values
    that share a place only raise the bound.
    """

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, b: Bounds):
        self.b, vectors = b, (left[b.source_vector], right[b.vector])
        width = max((len(v) for side in vectors for v in side if v is not None), default=1)
        self.u, self.v = (_rows(v, width) if not b.unit else _unit(v, width)[0] for v in vectors)
        reach = abs(b.weight) * np.linalg.norm(self.u, axis=1) * np.linalg.norm(self.v, axis=1).max()
        self.shut = 1e4 + 4 * reach.max()
        self.codes = {}
        lefts, rights = [b.weight * self.u], [self.v]
        for name in dict.fromkeys([*(c for c, _ in b.same), *b.must]):
            code = pd.factorize(pd.concat([left[name], right[name]], ignore_index=True))[0]
            self.codes[name] = x, y = code[: len(left)], code[len(left) :]
            held = np.eye(PLACES_HELD + 1)
            here, there = (held[np.where(c < 0, 0, c % PLACES_HELD + 1)] for c in (x, y))
            for gain in (g for c, g in b.same if c == name):
                lefts.append(gain * here[:, 1:])
                rights.append(there[:, 1:])
            if name in b.must:
                lefts.append(np.where(x < 0, 0, -self.shut)[:, None] * (1 - here))
                rights.append(there)
        self.extra = b.near[1] if b.near else 0.0
        self.slack = 4e-5 * reach + 1e-5 * (1 + sum(g for _, g in b.same) + self.extra)
        kind = np.float32 if reach.max() < 1e30 else np.float64
        self.left, self.right = (np.concatenate(m, axis=1).astype(kind) for m in (lefts, rights))
        number = lambda side, name: side[name].astype(float).to_numpy()
        self.near = (number(left, b.near[0]), number(right, b.near[0])) if b.near else None
        self.between = (number(right, b.between[0]), number(left, b.between[1]), number(left, b.between[2])) if b.between else None
        self.own = (left["source_id"].to_numpy(), right["item_id"].to_numpy()) if "source_id" in left and "item_id" in right else None

    def scores(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of ``r`` and ``c`` that count, and their scores."""
        ok = np.ones(len(r), dtype=bool)
        if self.own:
            ok &= self.own[0][r] != self.own[1][c]
        for name in self.b.must:
            x, y = self.codes[name]
            ok &= (x[r] < 0) | (x[r] == y[c])
        if self.between:
            cost, low, high = self.between
            ok &= ~((cost[c] < low[r]) | (cost[c] > high[r]))
            if self.b.strict:
                ok &= ~np.isnan(cost[c]) | (np.isnan(low[r]) & np.isnan(high[r]))
        r, c = r[ok], c[ok]
        product = np.einsum("ij,ij->i", self.u[r], self.v[c])
        out = self.b.weight * (np.round(product, PLACES) if self.b.unit else product)
        for name, gain in self.b.same:
            x, y = self.codes[name]
            out += gain * ((x[r] >= 0) & (x[r] == y[c]))
        if self.near:
            out += self.extra * np.exp(-((self.near[0][r] - self.near[1][c]) ** 2) / 2)
        ok = np.isfinite(out)
        return r[ok], c[ok], out[ok]


def best_by_product(left: pd.DataFrame, right: pd.DataFrame, b: Bounds, need: str, source_key: str, item_key: str) -> pd.DataFrame:
    """(source, item, score) of the best items of every source of one cell, of all its pairs.

    Tiles of upper bounds come from a matrix product; pairs whose bound reaches their source's n-th score so far are
    scored exactly, ``PAIRS`` at a time, and what is kept is at most the wanted number per source and one such batch.
    """
    if left.empty or right.empty:
        return pd.DataFrame({source_key: [], item_key: [], "score": []})
    cell, ids, wanted = _Cell(left, right, b), right[item_key].to_numpy(), left[need].to_numpy().astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), TILE[0]):
        want = wanted[at : at + TILE[0]]
        least, at_last = np.where(want > 0, -np.inf, np.inf), np.zeros(len(want), dtype=np.int64)
        kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

        def take(r: np.ndarray, c: np.ndarray) -> None:
            nonlocal kept
            for i in range(0, len(r), PAIRS):
                x, y, s = cell.scores(r[i : i + PAIRS] + at, c[i : i + PAIRS])
                bar = least[x - at]
                good = (s > bar) | ((s == bar) & (ids[y] < ids[at_last[x - at]]))
                x, y, s = (np.concatenate([a, n]) for a, n in zip(kept, (x[good] - at, y[good], s[good])))
                order = np.lexsort((ids[y], -s, x))
                x, y, s = x[order], y[order], s[order]
                rank = np.arange(len(x)) - np.searchsorted(x, x)
                last = rank == want[x] - 1
                least[x[last]], at_last[x[last]] = s[last], y[last]
                kept = tuple(a[rank < want[x]] for a in (x, y, s))

        for to in range(0, len(right), TILE[1]):
            upper = cell.left[at : at + TILE[0]] @ cell.right[to : to + TILE[1]].T
            few = 2 * int(np.median(want)) + 16
            head = upper[:, : max(HEAD, 2 * few)]
            if not to and few < head.shape[1]:
                # The likeliest pairs of a few columns first: their scores rule out most of the others.
                c = np.argpartition(head, -few, axis=1)[:, -few:]
                r = np.repeat(np.arange(len(upper)), few)
                take(r, c.ravel())
                np.put_along_axis(upper, c, -np.inf, axis=1)
            floor = least - cell.extra - cell.slack[at : at + TILE[0]]
            reached = upper >= (np.maximum(floor, -cell.shut / 2) if b.must else floor)[:, None]
            hits = np.flatnonzero(reached & (upper > -np.inf)) if np.isinf(floor).any() else np.flatnonzero(reached)
            if len(hits):
                take(hits // upper.shape[1], hits % upper.shape[1] + to)
        done.append((kept[0] + at, kept[1], kept[2]))
    r, c, s = (np.concatenate(x) for x in zip(*done))
    return pd.DataFrame({source_key: left[source_key].to_numpy()[r], item_key: ids[c], "score": s})


def nearest(sources: DataFrame, items: DataFrame, score: Score, bounds: Bounds, n: int, source_key: str = "source_id", item_key: str = "item_id",
            block_rows: int = BLOCK_ROWS, visits: Visits | None = None) -> DataFrame:
    """Best ``n`` items per source, of all pairs: ``score`` as ``bounds`` describes it.

    A few blocks of items are compared in full. More are compared in cells of up to ``DENSE`` blocks a side, where a matrix product
    tells which pairs need a score; a row is sent once per cell of its side. Beyond ``DENSE_ITEMS``, or where ``visits`` asks for it, items
    are indexed. The result is the same.
    """
    size = items.count()
    if size <= SMALL * block_rows:
        return block_top_n(sources, items, score, n, source_key, item_key, block_rows)
    if visits is None and size <= DENSE_ITEMS:
        rows = min(max(ceil(max(size, sources.count()) / 8), block_rows), DENSE * block_rows)
        return block_top_n(sources, items, bounds, n, source_key, item_key, rows, best_by_product)
    return Index(items, bounds, item_key, block_rows).top_n(sources, score, n, source_key, visits)
