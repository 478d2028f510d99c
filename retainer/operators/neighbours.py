"""Exact k nearest neighbours among many points, by Voronoi cells around sampled pivots.

1. Points are dealt to the nearest of ``FAN`` pivots (a sample by hash); a cell with more than
   ``CELL`` points draws pivots of its own and is dealt again, so a dense region is split as long as
   it is crowded.  Pivots travel as one row for each crowded cell.
2. Blocks of consecutive points in the order of the cells give each point k real candidates; their
   k-th distance ``r`` bounds the distance of its true k-th neighbour from above.
3. Each point descends from the root into the cells its ball of radius r can reach.  A cell is left out by
   the triangle inequality (pivot farther than r plus the cell's covering radius) or because the ball
   lies on the near side of the plane between the nearest pivot and the cell's.
4. Exact distances to the points of the cells reached; top k by a window for each point.

The result is exact for any points.  The work follows the number of cells within reach, hence how many
dimensions the points really fill: near-uniform points in many dimensions reach most cells with any bound.
Depth ends at ``DEPTH`` levels; cells still crowded then are searched as they are.

Distances are taken in tasks, a block at a time: of the points of a cell those in reach by groups of at most ``SEARCHED``.
Distances to pivots are taken a batch at a time in tasks, to which the pivots of up to ``stats.BROADCAST_ROWS`` crowded cells
are broadcast; those of more cells are joined to the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer.operators.stats import BROADCAST_ROWS, attach, row_positions
from retainer.session import written

FAN = 32            # pivots of a crowded cell
CELL = 64           # points up to which a cell is not split
DEPTH = 12          # levels whose cell numbers fit a long: (FAN + 1) ** 12 < 2 ** 63
_LOOSE = 1e-9       # relative slack of bounds, so that rounding never drops a neighbour


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def _columns(table: pa.Table, vector: str) -> np.ndarray:
    """The entries of an array column, one row an entry."""
    flat = pc.list_flatten(table.column(vector)).to_numpy()
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1).T) if table.num_rows else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all columns of ``a`` to those of ``b``, summed as ``_dist2`` does."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        d = x[:, None] - y[None, :]
        d *= d
        out += d
    return np.sqrt(out)


SEARCHED = 20_000   # searching points of a cell in one group
SPAN = 32           # blocks of one group
BATCH = 2_048       # points whose distances to pivots are taken together


class Pivots:
    """The pivots of crowded cells, flat, in the order of the cells and their numbers."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("_cell")
        lists = table.column("_pivots").combine_chunks()
        flat = pc.list_flatten(lists)
        self.cells = table.column("_cell").to_numpy()
        self.counts = pc.list_value_length(lists).to_numpy()
        self.first = np.cumsum(self.counts) - self.counts
        fields = {f.name for f in flat.type}
        self.no = pc.struct_field(flat, "no").to_numpy()
        self.columns = np.ascontiguousarray(pc.list_flatten(pc.struct_field(flat, "pv")).to_numpy().reshape(len(flat), -1).T)
        self.child, self.radius = (pc.struct_field(flat, f).to_numpy() if f in fields else None for f in ("child", "radius"))

    def distances(self, batch: pa.RecordBatch):
        """For runs of points in crowded cells: (their places, the place of each pair's point in the run, its pivot, squared distance, the
        first pair of each point, the pair of its nearest pivot)."""
        cell = batch.column("_cell").to_numpy()
        at = np.searchsorted(self.cells, cell)
        at[at == len(self.cells)] = 0
        crowded = np.flatnonzero(self.cells[at] == cell)
        v = np.ascontiguousarray(batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).T)
        for i in range(0, len(crowded), BATCH):
            rows = crowded[i : i + BATCH]
            n = self.counts[at[rows]]
            start, point = np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n)
            pivot = np.arange(n.sum()) + np.repeat(self.first[at[rows]] - start, n)
            d2 = np.zeros(len(pivot))
            for x, p in zip(v, self.columns):
                d = x[rows][point] - p[pivot]
                d2 += d * d
            least = np.minimum.reduceat(d2, start)
            near = np.flatnonzero(d2 == least[point])
            _, one = np.unique(point[near], return_index=True)  # the first of equals
            yield rows, point, pivot, d2, start, near[one]


def _few(per_cell: DataFrame) -> bool:
    return per_cell.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _dealt(placed: DataFrame, pivots: DataFrame, fan: int) -> DataFrame:
    """``placed`` with ``_parent``, the cell that it was in, ``_cell``, the one that it is dealt to, and ``_d2``."""
    sent = placed.sparkSession.sparkContext.broadcast(Pivots(pivots.select("_cell", "_pivots").toArrow()))
    names = [c for c in placed.columns if c != "_cell"]

    def deal(batches):
        for batch in batches:
            if not len(batch):
                continue
            parent = batch.column("_cell").to_numpy()
            cell, least = parent.copy(), np.full(len(batch), np.nan)
            for rows, _, pivot, d2, _, best in sent.value.distances(batch):
                cell[rows], least[rows] = parent[rows] * (fan + 1) + sent.value.no[pivot[best]] + 1, d2[best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parent), pa.array(cell), pa.array(least, mask=np.isnan(least))],
                                             names=[*names, "_parent", "_cell", "_d2"])

    schema = placed.select(*names, F.col("_cell").alias("_parent"), "_cell", F.lit(None).cast("double").alias("_d2")).schema
    return placed.mapInArrow(deal, schema)


def voronoi(points: DataFrame, cell: int = CELL, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """Cells of ``points`` (_id, _v, ...): the points with ``_cell``, and for each level one row a split
    cell: ``_cell``, ``_pivots`` array of (no, child, pv, radius), radius the farthest member's distance.

    The child of cell c at pivot number i is c * (fan + 1) + i + 1; the root is 0."""
    placed = written(points.withColumn("_cell", F.lit(0).cast("bigint")), "voronoi")
    levels: list[DataFrame] = []
    for depth in range(DEPTH):
        crowded = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), (F.min("_v") != F.max("_v")).alias("_differ"))
        crowded = crowded.where((F.col("_n") > cell) & F.col("_differ")).select("_cell")
        crowded = written(crowded.withColumn("_split", F.lit(True)), "voronoi-crowded")
        if not crowded.limit(1).count():
            break
        marked = attach(placed, crowded, ["_cell"])
        first = Window.partitionBy("_cell").orderBy(F.xxhash64("_id", F.lit(depth)), "_id")
        drawn = (marked.where("_split").select("_cell", "_id", "_v", F.row_number().over(first).alias("_no"))
                 .where(F.col("_no") <= fan))
        pivots = written(drawn.groupBy("_cell").agg(F.sort_array(F.collect_list(
            F.struct((F.col("_no") - 1).alias("no"), F.col("_v").alias("pv")))).alias("_pivots")), "voronoi-pivots")
        if _few(pivots):
            dealt = written(_dealt(placed, pivots, fan), "voronoi")
        else:
            near = F.array_min(F.transform("_pivots", lambda p: F.struct(_dist2(F.col("_v"), p["pv"]).alias("d"), p["no"].alias("no"))))
            dealt = attach(marked.drop("_split"), pivots, ["_cell"]).withColumn("_near", near)
            child = F.col("_cell") * (fan + 1) + F.col("_near.no") + 1
            dealt = written(dealt.select(*points.columns, F.col("_cell").alias("_parent"), F.coalesce(child, "_cell").alias("_cell"),
                                         F.col("_near.d").alias("_d2")), "voronoi")
        reach = (dealt.where("_d2 is not null").groupBy("_parent", "_cell").agg(F.sqrt(F.max("_d2")).alias("_radius")))
        flat = pivots.select(F.col("_cell").alias("_parent"), F.explode("_pivots").alias("p")).withColumn(
            "_cell", F.col("_parent") * (fan + 1) + F.col("p.no") + 1)
        level = (flat.join(reach, ["_parent", "_cell"]).groupBy("_parent").agg(F.sort_array(F.collect_list(
            F.struct(F.col("p.no").alias("no"), F.col("_cell").alias("child"), F.col("p.pv").alias("pv"), F.col("_radius").alias("radius")))).alias("_pivots")))
        levels.append(written(level.withColumnRenamed("_parent", "_cell"), "voronoi-level"))
        placed = dealt.drop("_parent", "_d2")
    return placed, levels


def bounds(placed: DataFrame, k: int, block: int = 32) -> DataFrame:
    """(_id, _r): a distance within which each point has k others, copies counted; points
    with k copies of their own, or without k others near by, are left out."""
    block = max(block, k + 1)
    ranked = row_positions(placed, [F.col("_cell"), F.col("_id")], "_rank")
    blk = F.floor(F.col("_rank") / F.lit(block))
    spans = F.array_distinct(F.array(*[F.floor((blk + i) / F.lit(SPAN)) for i in (-1, 0, 1)]))
    spread = ranked.select("_id", "_v", "_m", blk.alias("_b"), F.explode(spans).alias("_span"))

    def radii(table: pa.Table) -> pa.Table:
        """The radius of each point in the blocks of a span, from its own block and the two next to it."""
        table = table.sort_by("_b")
        span = table.column("_span")[0].as_py()
        ids, m, b, v = *(table.column(c).to_numpy() for c in ("_id", "_m", "_b")), _columns(table, "_v")
        edge = np.searchsorted(b, np.arange(span * SPAN - 1, (span + 1) * SPAN + 2))  # first row of each block and of the one before
        out_id, out_r = [], []
        for i in range(1, SPAN + 1):
            low, high = edge[i - 1], edge[i + 2] if i + 2 < len(edge) else len(b)
            a = np.arange(edge[i], edge[i + 1])
            a = a[m[a] - 1 < k]
            if not len(a):
                continue
            d = _distances(v[:, a], v[:, low:high])
            d[np.arange(len(a)), a - low] = np.inf  # itself
            order = d.argsort(axis=1, kind="stable")
            d = np.take_along_axis(d, order, axis=1)
            enough = (np.cumsum(m[low:high][order], axis=1) + m[a][:, None] - 1 >= k) & (d < np.inf)
            some = enough.any(axis=1)
            out_id.append(ids[a][some])
            out_r.append(d[np.arange(len(a)), enough.argmax(axis=1)][some])
        return pa.table({"_id": pa.array(np.concatenate([np.zeros(0, np.int64), *out_id]), pa.int64()), "_r": pa.array(np.concatenate([np.zeros(0), *out_r]), pa.float64())})

    return spread.groupBy("_span").applyInArrow(radii, "_id long, _r double")


def _entered(at: DataFrame, level: DataFrame) -> DataFrame:
    """``at`` (_id, _v, _r, _cell) with a row for each child that a point's ball can reach; cells that are not split stay."""
    sent = at.sparkSession.sparkContext.broadcast(Pivots(level.select("_cell", "_pivots").toArrow()))

    def enter(batches):
        for batch in batches:
            if not len(batch):
                continue
            p, r = sent.value, batch.column("_r").to_numpy(zero_copy_only=False) * (1 + _LOOSE)
            whole, from_, to = np.ones(len(batch), bool), [], []
            for rows, point, pivot, d2, _, best in p.distances(batch):
                whole[rows] = False
                nearest, rb = pivot[best][point], r[rows][point]
                apart = np.zeros(len(d2))
                for x in p.columns:
                    d = x[pivot] - x[nearest]
                    apart += d * d
                covered = np.sqrt(d2) * (1 - _LOOSE) <= (p.radius[pivot] + rb) * (1 + _LOOSE)
                least = d2[best][point]
                plane = d2 - least <= np.sqrt(apart) * rb * 2 + (d2 + least) * _LOOSE
                open_ = covered & ((pivot == nearest) | plane)
                from_.append(rows[point[open_]])
                to.append(p.child[pivot[open_]])
            stay = np.flatnonzero(whole)
            rows = np.concatenate([stay, *from_])
            cells = np.concatenate([batch.column("_cell").to_numpy()[stay], *to])
            for i in range(0, len(rows), 10_000):
                some = batch.take(pa.array(rows[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("_id", "_v", "_r")), pa.array(cells[i : i + 10_000])], names=["_id", "_v", "_r", "_cell"])

    return at.select("_id", "_v", "_r", "_cell").mapInArrow(enter, at.select("_id", "_v", "_r", "_cell").schema)


def reached(search: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """One row for each point of ``search`` (_id, _v, _r) and final cell that its ball can reach: adds ``_cell``."""
    at = search.withColumn("_cell", F.lit(0).cast("bigint"))
    rb = F.col("_r") * F.lit(1 + _LOOSE)
    for level in levels:
        if _few(level):
            at = written(_entered(at, level), "knn-reached")
            continue
        seen = attach(at, level, ["_cell"])
        far = F.transform("_pivots", lambda p: F.struct(_dist2(F.col("_v"), p["pv"]).alias("d2"), p["no"].alias("no"), p["child"].alias("child"),
                                                        p["pv"].alias("pv"), p["radius"].alias("radius")))
        seen = seen.withColumn("_far", far).withColumn("_best", F.array_min(F.transform(
            "_far", lambda p: F.struct(p["d2"].alias("d2"), p["no"].alias("no"), p["pv"].alias("pv")))))

        def open_(p: Column) -> Column:
            best = F.col("_best")
            covered = F.sqrt(p["d2"]) * (1 - _LOOSE) <= (p["radius"] + rb) * (1 + _LOOSE)
            plane = p["d2"] - best["d2"] <= F.sqrt(_dist2(p["pv"], best["pv"])) * rb * 2 + (p["d2"] + best["d2"]) * _LOOSE
            return covered & ((p["no"] == best["no"]) | plane)

        into = F.transform(F.filter("_far", open_), lambda p: p["child"])
        at = written(seen.select(*search.columns, F.explode(F.when(F.col("_pivots").isNull(), F.array("_cell")).otherwise(into)).alias("_cell")), "knn-reached")
    return at


def within(search: DataFrame, placed: DataFrame) -> DataFrame:
    """(_id, _nid, _nm, _d): the points of a cell (``placed``) within ``_r`` of a point that searches it (``search``: _id, _v, _r, _cell)."""
    asked = search.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SEARCHED)).alias("_parts"))
    asked = written(asked, "knn-asked")
    left = attach(search, asked, ["_cell"]).withColumn("_part", F.pmod(F.xxhash64("_id"), "_parts")).drop("_parts")
    right = placed.join(asked, "_cell").select("_cell", F.col("_id").alias("_nid"), F.col("_v").alias("_nv"), F.col("_m").alias("_nm"),
                                               F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))

    def near(search: pa.Table, points: pa.Table) -> pa.Table:
        ids, r, v = search.column("_id").to_numpy(), search.column("_r").to_numpy(), _columns(search, "_v")
        nid, nm, nv = points.column("_nid").to_numpy(), points.column("_nm").to_numpy(), _columns(points, "_nv")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, (1 << 16) // max(1, len(nid)))
        for i in range(0, len(ids) if len(nid) else 0, step):
            d = _distances(v[:, i : i + step], nv)
            a, b = np.nonzero((d <= r[i : i + step, None]) & (ids[i : i + step, None] != nid[None, :]))
            out.append((ids[i + a], nid[b], nm[b], d[a, b]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("_id", "_nid", "_nm", "_d"), zip(*out))})

    return left.groupBy("_cell", "_part").cogroup(right.groupBy("_cell", "_part")).applyInArrow(near, "_id long, _nid long, _nm long, _d double")


def knn_within(points: DataFrame, k: int, dim: int | None = None, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """Exact k nearest neighbours (Euclidean) among distinct vectors with
    multiplicities.  ``points``: (_id, _v array<double>, _m copies).
    Returns (_id, nbr_rank 1..k, nbr_id, dist); a point's own copies come
    first at distance 0 and a neighbour with c copies fills c ranks, ties to the smaller id.
    Points with at least k other copies need no search and have their copies only.

    ``dim`` is kept for callers; the vectors' own length counts.  An empty table gives no rows."""
    placed, levels = voronoi(points.select("_id", "_v", "_m"), cell, fan)
    radius = written(bounds(placed, k), "knn-bounds")
    search = placed.join(radius, "_id").select("_id", "_v", "_r")
    found = reached(search, levels)
    pairs = within(found if levels else written(found, "knn-search"), placed)
    own = points.where(F.col("_m") > 1).select(
        "_id", F.col("_id").alias("_nid"), (F.col("_m") - 1).alias("_nm"), F.lit(0.0).alias("_d"))
    order = Window.partitionBy("_id").orderBy("_d", F.col("_nid") != F.col("_id"), "_nid")
    ranked = (pairs.unionByName(own).withColumn("_end", F.sum("_nm").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_start", F.col("_end") - F.col("_nm") + 1).where(F.col("_start") <= k))
    filled = F.sequence(F.col("_start").cast("int"), F.least(F.col("_end"), F.lit(k)).cast("int"))
    return ranked.select("_id", F.explode(filled).alias("nbr_rank"), F.col("_nid").alias("nbr_id"), F.col("_d").alias("dist"))


def candidate_pairs(points: DataFrame, k: int, cell: int = CELL, fan: int = FAN) -> int:
    """How many pairs the search compares on ``points``, the blocks of the bounds left out."""
    placed, levels = voronoi(points.select("_id", "_v", "_m"), cell, fan)
    search = placed.join(bounds(placed, k), "_id").select("_id", "_v", "_r")
    sizes = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    asked = reached(search, levels).groupBy("_cell").agg(F.count(F.lit(1)).alias("q"))
    return asked.join(sizes, "_cell").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0))).first()[0]
