"""Exact nearest neighbours, and what is built on them (BAL1, BAL2).

Of equal vectors only the first ``k + 1`` rows can be among the ``k`` nearest of any row, so these are the
candidates, and equal vectors that ask are asked for once.

Along one coordinate the candidates are put in order (a range partitioning; places from the counts of the partitions
before) and cut into half blocks. A row's nearest are in its own half block and the two beside it, as a half block holds more rows
than its nearest can. A group holds ``HALVES`` half blocks and one more on either side.

With more coordinates, median cuts of a sample divide the space into cells of bounded size; only where the cuts lie
comes from the sample. A row first asks its own cell, which bounds how far its nearest can be, and then every other cell that reaches into that
distance. A cell that many rows ask is dealt over several groups. Inside a group, boxes of rows that lie together are
skipped or compared by one matrix product. Where no cell can be ruled out (many coordinates), every row meets every other one,
in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.operators.keyed import hash_rank, places_in_order, written
from risklib.schema import LABEL

BLOCK = 512
SEED = 42
SLICE = 20_000  # candidates whose distances are taken at once
HALVES = 16  # half blocks whose rows look for their neighbours in one group
CELL_ROWS, CELL_BYTES = 50_000, 16 << 20  # what a cell holds at most, about
LEAST_CELL = 8_192  # fewer rows are not cut for the sake of more tasks
SAMPLED = 100  # rows of the sample per cell
WIDTH = 2_048  # candidates in one matrix product


def vector_of(cols: Sequence[str]) -> Column:
    """The columns as one array of doubles; null where one of them is null or not a number."""
    xs = [F.col(f"`{c}`").cast("double") for c in cols]
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull() & ~F.isnan(x)
    return F.when(ok, F.array(*xs))


def first_copies(v: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows with at most ``k`` equal rows before them: the others are not among the ``k`` nearest of any row."""
    kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    copy = np.arange(len(v)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[copy <= k])


def nearest_in(v: np.ndarray, ask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, distance) of the ``k`` nearest other rows of every row that asks; ties go to the earlier row."""
    n = len(v)
    k = min(k, n - 1)
    who = np.flatnonzero(ask)
    if k <= 0 or not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cols = first_copies(v, k)
    c = v - v.mean(axis=0)
    size = (c * c).sum(axis=1)
    d2 = size[who, None] + size[None, cols] - 2 * c[who] @ c[cols].T
    own = np.minimum(np.searchsorted(cols, who), len(cols) - 1)
    mine = np.flatnonzero(cols[own] == who)
    d2[mine, own[mine]] = np.inf
    # all that may be among the nearest, ties and rounding included; then their distances without cancellation
    reach = np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-12 * max(float(size.max()), 1e-300) * v.shape[1]
    row, col = np.nonzero(d2 <= reach[:, None])
    col = cols[col]
    exact = np.concatenate([np.sqrt(((v[col[i:i + SLICE]] - v[who[row[i:i + SLICE]]]) ** 2).sum(axis=1))
                            for i in range(0, len(row), SLICE)])
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(who)))
    keep = np.arange(len(row)) - first[row] < k
    return who[row[keep]], col[keep], exact[keep]


def half_block_groups(placed: DataFrame, half: int) -> DataFrame:
    """The placed rows with their group ``g`` of ``HALVES`` half blocks; rows at a group's edge are in the one beside it too."""
    rows_in = half * HALVES
    own, at = F.floor(F.col("place") / rows_in), F.col("place") % rows_in
    beside = F.array_compact(F.array(own, F.when(at < half, own - 1), F.when(at >= rows_in - half, own + 1)))
    return placed.withColumn("g", F.explode(beside)).where("g >= 0")


def leaves(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order of the rows in which those from one start to the next, ``size`` at most, lie together."""
    todo, done = [np.arange(len(v))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        x = v[at]
        half = len(at) // 2
        cut = np.argpartition(x[:, np.argmax(x.max(axis=0) - x.min(axis=0))], half)
        todo += [at[cut[half:]], at[cut[:half]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


def nearest_between(a: np.ndarray, reach: np.ndarray, c: np.ndarray, r: np.ndarray, k: int,
                    block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, distance, id) of the at most ``k`` rows of ``c`` (ids ``r``) nearest to every row of ``a`` and no farther than
    its ``reach``; in order of row, distance and id."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if not len(a) or not len(c):
        return found[0]
    dims = c.shape[1]
    asking, ask_starts = leaves(a, max(1, block // 4))
    order, starts = leaves(c, max(1, block // 8))
    c, r = c[order], r[order]
    low, high = np.minimum.reduceat(c, starts[:-1]), np.maximum.reduceat(c, starts[:-1])
    rows_of = np.diff(starts)
    for s, e in zip(ask_starts[:-1], ask_starts[1:]):
        who = asking[s:e]
        x, limit = a[who], reach[who].copy()
        least, most, middle = x.min(axis=0), x.max(axis=0), x.mean(axis=0)
        gap = (np.maximum(0, np.maximum(low - most, least - high)) ** 2).sum(axis=1) * (1 - 1e-9)  # no row of a box is nearer
        boxes = np.argsort(gap, kind="stable")
        upto = np.cumsum(rows_of[boxes])
        xc = x - middle
        xs = (xc * xc).sum(axis=1)
        left = np.column_stack([-2 * xc, xs, np.ones(len(x))])  # the product with (z, 1, |z|^2) is the square of the distance
        best = found[0]
        i = 0
        while i < len(boxes) and gap[boxes[i]] <= float(limit.max()) ** 2:
            # the nearest boxes with at least k rows first: they bound the others
            j = np.searchsorted(upto, (upto[i - 1] if i else 0) + (WIDTH if i else k)) + 1
            if i:
                j = min(j, i + np.searchsorted(gap[boxes[i:]], float(limit.max()) ** 2, "right"))
            at = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in boxes[i:j]])
            i = j
            right = np.ones((len(at), dims + 2))
            z = np.subtract(c[at], middle, out=right[:, :dims])
            zs = right[:, -1] = np.einsum("ij,ij->i", z, z)
            d2 = left @ right.T
            slack = 1e-12 * max(float(xs.max()), float(zs.max()), 1e-300) * dims
            bound = limit ** 2 * (1 + 1e-9) + slack
            near = d2 <= bound[:, None]
            if len(at) > k and np.count_nonzero(near) > 4 * k * len(x):
                bound = np.minimum(bound, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack)
                near = d2 <= bound[:, None]
            row, col = np.divmod(np.flatnonzero(near), len(at))
            if not len(row):
                continue
            # what may be among the nearest, rounding included; then their distances without cancellation
            away = np.concatenate([np.sqrt(((c[at[col[n:n + SLICE]]] - x[row[n:n + SLICE]]) ** 2).sum(axis=1))
                                   for n in range(0, len(row), SLICE)])
            keep = away <= limit[row]
            row, away, ids = (np.concatenate(p) for p in zip(best, (row[keep], away[keep], r[at[col[keep]]])))
            by = np.lexsort((ids, away, row))
            row, away, ids = row[by], away[by], ids[by]
            rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row]
            limit[row[rank == k - 1]] = away[rank == k - 1]
            best = (row[rank < k], away[rank < k], ids[rank < k])
        found.append((who[best[0]], best[1], best[2]))
    row, away, ids = (np.concatenate(p) for p in zip(*found))
    by = np.argsort(row, kind="stable")
    return row[by], away[by], ids[by]


class Cells:
    """The space cut into about ``cells`` parts: at the medians of ``sample`` along its widest coordinate, again and again."""

    def __init__(self, sample: np.ndarray, cells: int):
        dims = sample.shape[1]
        self.cuts: list[tuple[int, float, int, int]] = []  # coordinate, cut, and where it goes on below and from the cut on: a cut, or -1 - cell
        self.low, self.high = [], []
        depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        self.start = self._cut(sample, depth, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.n = len(self.low)

    def _cut(self, v: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
        wide = v.max(axis=0) - v.min(axis=0) if len(v) else np.zeros(len(low))
        d = int(np.argmax(wide))
        if depth == 0 or not wide[d] > 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        x = v[:, d]
        at = np.partition(x, len(x) // 2)[len(x) // 2]
        if at == x.min():
            at = x[x > at].min()
        mine = len(self.cuts)
        self.cuts.append((d, float(at), 0, 0))
        below, above = high.copy(), low.copy()
        below[d] = above[d] = at
        self.cuts[mine] = (d, float(at), self._cut(v[x < at], depth - 1, low, below), self._cut(v[x >= at], depth - 1, above, high))
        return mine

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        at = np.full(len(v), self.start)
        dim, cut, left, right = (np.array(x) for x in zip(*self.cuts)) if self.cuts else (np.zeros(0),) * 4
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            at[open_] = np.where(v[open_, dim[node]] >= cut[node], right[node], left[node])
        return -1 - at

    def within(self, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells other than a row's own that come as near to it as its ``reach``."""
        own, rows, cells = self.of(v), [], []
        far = reach ** 2 * (1 + 1e-9)
        for cell in range(self.n):
            gap = np.zeros(len(v))
            for d in np.flatnonzero(np.isfinite(self.low[cell]) | np.isfinite(self.high[cell])):
                gap += np.maximum(0, np.maximum(self.low[cell][d] - v[:, d], v[:, d] - self.high[cell][d])) ** 2
            at = np.flatnonzero((gap * (1 - 1e-9) <= far) & (own != cell))
            rows.append(at)
            cells.append(np.full(len(at), cell))
        return np.concatenate(rows), np.concatenate(cells)


NEAR = "near array<struct<distance:double,neighbour:long>>"


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten()).reshape(len(whole), -1)


def _lists(row: np.ndarray, away: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The rows that occur, and per row the list of its (distance, neighbour)."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(away), pa.array(ids)], ["distance", "neighbour"])
    return row[first], pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pairs)


def _along_a_line(points: DataFrame, k: int, block: int) -> DataFrame:
    """(v, near) of the asking ``points`` of one coordinate, themselves included."""
    half = max(block // 2, 3 * k + 2)  # on either side there are at most 2 k rows, after k of the same value, before all nearest are seen
    placed = places_in_order(points.withColumn("at", F.get("v", F.lit(0))), [], ["at", "r"], "place")
    groups = half_block_groups(placed.select("r", "v", "ask", "place"), half)

    def meet(key, table):
        table = table.sort_by("place")
        place, r, ask = (np.asarray(table.column(c)) for c in ("place", "r", "ask"))
        v = _vectors(table.column("v"))
        start = key[0].as_py() * half * HALVES
        cuts = np.searchsorted(place, start + half * np.arange(-1, HALVES + 2))
        mine = ask & (np.arange(len(r)) >= cuts[1]) & (np.arange(len(r)) < cuts[HALVES + 1])
        found = [(np.flatnonzero(mine), np.zeros(mine.sum()), r[mine])]
        for i in range(HALVES):  # a half block and the two beside it
            at = np.arange(cuts[i], cuts[min(i + 3, HALVES + 2)])
            at = at[np.argsort(r[at], kind="stable")]
            a, b, d = nearest_in(v[at], mine[at] & (at >= cuts[i + 1]) & (at < cuts[i + 2]), k)
            found.append((at[a], d, r[at[b]]))
        row, away, ids = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((ids, away, row))
        row, near = _lists(row[by], away[by], ids[by])
        return pa.table({"v": table.column("v").take(pa.array(row)), "near": near})

    return groups.groupBy("g").applyInArrow(meet, f"v array<double>, {NEAR}")


def _in_cells(points: DataFrame, k: int, block: int, seed: int) -> DataFrame:
    """(v, near) of the asking ``points``, themselves included: the ``k + 1`` nearest by distance, then by row number."""
    spark = points.sparkSession
    n, dims, cores = points.count(), len(points.first()["v"]), spark.sparkContext.defaultParallelism
    cells = max(-(-n // min(CELL_ROWS, max(1, CELL_BYTES // (8 * dims)))), min(4 * cores, n // LEAST_CELL), 1)
    every = max(1, n // (SAMPLED * cells))
    drawn = points.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(every)) == 0).select("v").toArrow() if cells > 1 else None
    cut = Cells(np.unique(_vectors(drawn.column("v")), axis=0) if drawn is not None and len(drawn) else np.zeros((0, dims)), cells)

    def to_cells(batches):
        for b in batches:
            yield pa.record_batch({"cell": pa.array(cut.of(_vectors(b.column("v")))), "r": b.column("r"), "v": b.column("v"), "ask": b.column("ask")})

    def at_home(table):
        v, r, ask = _vectors(table.column("v")), np.asarray(table.column("r")), np.flatnonzero(np.asarray(table.column("ask")))
        row, near = _lists(*nearest_between(v[ask], np.full(len(ask), np.inf), v, r, k + 1, block))
        return pa.table({"v": table.column("v").take(pa.array(ask[row])), "near": near})

    placed = points.mapInArrow(to_cells, "cell long, r long, v array<double>, ask boolean")
    home = placed.repartition(max(1, 2 * cut.n), "cell").groupBy("cell").applyInArrow(at_home, f"v array<double>, {NEAR}")
    if cut.n == 1:
        return home
    reach = F.coalesce(F.get("near", F.lit(k))["distance"], F.lit(float("inf")))  # no k + 1 rows at home: all cells are asked
    home = written(home.select(F.monotonically_increasing_id().alias("a"), "v", "near", reach.alias("reach")), "neighbours-at-home")

    def tally(batches):
        seen = np.zeros(cut.n, np.int64)
        for b in batches:
            seen += np.bincount(cut.within(_vectors(b.column("v")), np.asarray(b.column("reach")))[1], minlength=cut.n)
        yield pa.record_batch({"cell": pa.array(np.arange(cut.n)), "asked": pa.array(seen)})

    asked = np.zeros(cut.n, np.int64)
    for t in home.select("v", "reach").mapInArrow(tally, "cell long, asked long").groupBy("cell").agg(F.sum("asked").alias("asked")).collect():
        asked[t["cell"]] = t["asked"]  # one row per cell
    if not asked.any():
        return home.select("v", "near")
    # rows that ask a cell are dealt over groups, each with the whole cell
    deal = min(CELL_ROWS, max(LEAST_CELL // 4, int(asked.sum()) // (4 * cores)))
    groups_of = -(-asked // deal)
    first = np.cumsum(groups_of) - groups_of

    def calls(batches):
        for b in batches:
            v, far, a = _vectors(b.column("v")), np.asarray(b.column("reach")), np.asarray(b.column("a"))
            row, cell = cut.within(v, far)
            take = pa.array(row)
            yield pa.record_batch({"g": pa.array(first[cell] + (a[row] * 7919 + (a[row] >> 33)) % groups_of[cell]), "id": pa.array(a[row]),
                                   "v": b.column("v").take(take), "reach": pa.array(far[row])})

    def answers(batches):
        for b in batches:
            cell = cut.of(_vectors(b.column("v")))
            row = np.repeat(np.arange(len(cell)), groups_of[cell])
            part = np.arange(len(row)) - np.repeat(np.cumsum(groups_of[cell]) - groups_of[cell], groups_of[cell])
            yield pa.record_batch({"g": pa.array(first[cell[row]] + part), "id": b.column("r").take(pa.array(row)),
                                   "v": b.column("v").take(pa.array(row)), "reach": pa.nulls(len(row), pa.float64())})

    def meet(table):
        far, ids, v = np.asarray(table.column("reach").fill_null(-1.0)), np.asarray(table.column("id")), _vectors(table.column("v"))
        ask, rest = np.flatnonzero(far >= 0), np.flatnonzero(far < 0)
        row, near = _lists(*nearest_between(v[ask], far[ask], v[rest], ids[rest], k + 1, block))
        return pa.table({"a": ids[ask[row]], "near": near})

    shape = "g long, id long, v array<double>, reach double"
    met = home.select("a", "v", "reach").mapInArrow(calls, shape).unionByName(points.select("r", "v").mapInArrow(answers, shape))
    away = met.repartition(max(1, int(groups_of.sum())), "g").groupBy("g").applyInArrow(meet, f"a long, {NEAR}")
    every = away.unionByName(home.select("a", "near")).groupBy("a").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    return home.select("a", "v").join(every, "a").select("v", "near")


def nearest_neighbours(rows: DataFrame, k: int = 5, block: int = BLOCK, seed: int = SEED, copies: bool = False) -> DataFrame:
    """(r, rank, neighbour, distance) for ``rows`` (r: row number, v: array<double>, ask: boolean).

    The ``k`` nearest rows of every row with ``ask``, ranked from 1 by distance, then by row number; exact.
    Rows without a number or without a ``v`` of finite numbers neither ask nor answer. Where numbers repeat, a row's copies are rows
    like others, and each (neighbour, distance) is listed once; with ``copies`` each copy is one of the ``k``, so fewer may be
    listed. ``block`` and ``seed`` tell how rows are grouped, not what is found.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("r").isNotNull() & F.col("v").isNotNull() & finite).select("r", "v", "ask")
    pairs = written(rows.groupBy("v", "r").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("ask")), "neighbour-pairs")
    some = pairs.first()
    if some is None:
        return rows.sparkSession.createDataFrame([], "r long, rank int, neighbour long, distance double")
    each = pairs.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int")))) if copies else pairs
    first = each.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("r"))).where(F.col("copy") <= k + 1)
    asking = pairs.where("ask").select("v").distinct().withColumn("asks", F.lit(True))
    points = written(first.join(asking, "v", "left").select(
        F.col("r").cast("long").alias("r"), "v", ((F.col("copy") == 1) & F.col("asks").isNotNull()).alias("ask")), "neighbour-points")
    found = _along_a_line(points, k, block) if len(some["v"]) == 1 else _in_cells(points, k, block, seed)
    # a row is not its own neighbour; its copies are
    own = F.when(F.lit(copies) | (F.col("n") == 1), F.array_position("near", F.struct(F.lit(0.0).alias("distance"), F.col("r").cast("long").alias("neighbour"))))
    other = pairs.where("ask").join(found, "v").withColumn("_own", F.coalesce(own, F.lit(0))).select(
        "r", F.filter("near", lambda x, i: i + 1 != F.col("_own")).alias("near"))
    every = other.groupBy("r").agg(F.sort_array(F.flatten(F.collect_list(F.slice("near", 1, k)))).alias("near"))
    best = every.select("r", F.slice(F.filter("near", lambda x, i: (i == 0) | (x != F.get("near", i - 1))), 1, k).alias("best"))
    return best.select("r", F.posexplode("best").alias("i", "x")).select(
        "r", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"))


def numbered(df: DataFrame, cols: Sequence[str], name: str = "neighbour-rows") -> DataFrame:
    """``df`` with a row number ``_r`` and the vector ``_v`` of ``cols``, written so that the numbers stay."""
    return written(df.withColumn("_r", F.monotonically_increasing_id()).withColumn("_v", vector_of(cols)), name)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '|' (52 bits; any SQL engine can repeat it)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return h / F.lit(float(1 << 52))


def _new_rows(base: DataFrame, near: DataFrame, cols: Sequence[str], key: str, seed: int) -> DataFrame:
    """New rows on the segments from ``base`` (with ``_n`` new rows each) to one of its neighbours.

    Adds ``copy`` (from 1), ``neighbour`` (its key) and ``gap``. Columns other than ``cols`` are the base row's.
    """
    of = near.groupBy(F.col("r").alias("_r")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))  # k at most
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    made = base.where(F.col("_n") > 0).join(of, "_r").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    made = made.withColumns({
        "_to": F.get("_near", F.floor(unit_hash(text, F.col("copy"), F.lit(f"neighbour{seed}")) * F.size("_near")).cast("int"))["neighbour"],
        "gap": unit_hash(text, F.col("copy"), F.lit(f"gap{seed}"))})
    other = base.select(F.col("_r").alias("_to"), F.col(key).alias("neighbour"), F.col("_v").alias("_w"))
    made = made.join(other, "_to")
    moved = {c: F.get("_v", F.lit(i)) + F.col("gap") * (F.get("_w", F.lit(i)) - F.get("_v", F.lit(i))) for i, c in enumerate(cols)}
    return made.withColumns(moved)


def _balanced(df: DataFrame, made: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    kept = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols}).withColumns({
        "copy": F.lit(0), "neighbour": F.lit(None).cast(df.schema[key].dataType), "gap": F.lit(None).cast("double")})
    return kept.unionByName(made.select(*kept.columns))


def _classes(df: DataFrame, label: str) -> tuple[int, int, int]:
    c = df.where(F.col(label).isNotNull()).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return (1 if c["p"] <= c["n"] else 0), min(c["p"], c["n"]), max(c["p"], c["n"])


# ---------------------------------------------------------------- BAL1
def smote(df: DataFrame, cols: Sequence[str], key: str, label: str = LABEL, k: int = 5, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Minority rows up to parity with new ones between a minority row and one of its ``k`` nearest minority rows.

    All rows of ``df`` are kept (``copy`` 0), also unlabelled ones. The new rows are spread evenly: every
    complete minority row gets ``missing div rows`` of them and the first ``missing mod rows`` by hash
    one more, so classes are equal afterwards. Minority rows with a null among ``cols`` are no
    ends of segments. ``cols`` become doubles; other columns are the base row's. Raises ValueError with fewer than two
    complete minority rows.
    """
    minority, n_min, n_maj = _classes(df, label)
    base = numbered(df.where(F.col(label) == minority), cols, "smote-rows").where(F.col("_v").isNotNull())
    n_base = base.count()
    missing = n_maj - n_min
    if missing == 0:
        return _balanced(df, df.limit(0).withColumns({"copy": F.lit(0), "neighbour": F.col(key), "gap": F.lit(0.0)}), cols, key)
    if n_base < 2:
        raise ValueError("SMOTE needs two minority rows without nulls")
    near = nearest_neighbours(base.select(F.col("_r").alias("r"), F.col("_v").alias("v"), F.lit(True).alias("ask")), k, block, seed)
    each, more = divmod(missing, n_base)
    spread = hash_rank(base, [], key, seed).withColumn("_n", F.when(F.col("hash_rank") < more, each + 1).otherwise(each)).drop("hash_rank")
    return _balanced(df, _new_rows(spread, near, cols, key, seed), cols, key)


# ---------------------------------------------------------------- BAL2
def largest_remainder(df: DataFrame, weight: str, total: int, key: str, out: str = "_n", seed: int = SEED) -> DataFrame:
    """``total`` dealt in proportion to the whole numbers in ``weight``: floors first, then one more for the largest remainders.

    Rows with equal weights have equal remainders, so the order of the remainders is a table of the distinct weights, and
    their running sum tells which weights get one more; within the weight that is reached only partly the first
    rows by hash do. ``weight`` takes few values (at most k + 1 for neighbour counts). Nulls count 0.
    """
    w = F.coalesce(F.col(weight), F.lit(0)).cast("long")
    table = df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("c")).collect()  # one row per distinct weight
    whole = sum(r["w"] * r["c"] for r in table)
    if not whole:
        return df.withColumn(out, F.lit(0).cast("long"))
    left = total - sum(total * r["w"] // whole * r["c"] for r in table)
    extra = {}
    for r in sorted(table, key=lambda r: (-(total * r["w"] % whole), -r["w"])):
        extra[r["w"]] = min(left, r["c"]) if total * r["w"] % whole else 0
        left -= extra[r["w"]]
    base, more = F.lit(None).cast("long"), F.lit(None).cast("long")
    for r in table:
        base = F.when(w == r["w"], F.lit(total * r["w"] // whole)).otherwise(base)
        more = F.when(w == r["w"], F.lit(extra[r["w"]])).otherwise(more)
    ranked = hash_rank(df.withColumn("_w", w), ["_w"], key, seed)
    return ranked.withColumn(out, base + (F.col("hash_rank") < more).cast("long")).drop("_w", "hash_rank")


def majority_neighbours(rows: DataFrame, key: str, label: str, minority: int, k: int = 5, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The minority rows of numbered ``rows`` with ``_majority``: how many of their ``k`` nearest rows are of the other class."""
    ask = F.col(label) == minority
    near = nearest_neighbours(rows.select(F.col("_r").alias("r"), F.col("_v").alias("v"), ask.alias("ask")), k, block, seed, copies=True)
    other = rows.where(~ask).select(F.col("_r").alias("neighbour"))
    counts = near.join(other, "neighbour").groupBy(F.col("r").alias("_r")).agg(F.count(F.lit(1)).alias("_majority"))
    return rows.where(ask).join(counts, "_r", "left").withColumn("_majority", F.coalesce("_majority", F.lit(0)))


def adasyn(df: DataFrame, cols: Sequence[str], key: str, label: str = LABEL, k: int = 5, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """As ``smote``, but a minority row gets new rows in proportion to the majority rows among its ``k`` nearest of all rows.

    The counts add up to parity exactly (``largest_remainder``). Unlabelled rows are kept and are nobody's
    neighbour. Raises ValueError when no minority row has a majority neighbour, or with fewer than two complete minority rows.
    """
    minority, n_min, n_maj = _classes(df, label)
    missing = n_maj - n_min
    if missing == 0:
        return _balanced(df, df.limit(0).withColumns({"copy": F.lit(0), "neighbour": F.col(key), "gap": F.lit(0.0)}), cols, key)
    rows = numbered(df.where(F.col(label).isNotNull()), cols, "adasyn-rows").where(F.col("_v").isNotNull())
    base = written(majority_neighbours(rows, key, label, minority, k, block, seed), "adasyn-counts")
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.sum("_majority").alias("m")).first()
    if seen["n"] < 2 or not seen["m"]:
        raise ValueError("ADASYN needs two minority rows without nulls, and majority rows among their neighbours")
    near = nearest_neighbours(base.select(F.col("_r").alias("r"), F.col("_v").alias("v"), F.lit(True).alias("ask")), k, block, seed)
    return _balanced(df, _new_rows(largest_remainder(base, "_majority", missing, key, seed=seed), near, cols, key, seed), cols, key)
