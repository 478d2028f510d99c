"""Distributed order statistics: running totals and exact quantiles.

Both avoid the two unscalable shortcuts -- a window with no PARTITION BY
(pulls every row into one task) and the ``percentile`` aggregate (keeps every
distinct value of a group in one buffer).

Running totals: rows are range-partitioned and sorted on (group keys, order
keys) and *written once* with the number of their slice; each slice sums on
its own and per-(slice, group) totals become prefix offsets.  Rows and offsets
come from the same written slices, so the result does not depend on how the
ranges were sampled or whether an exchange was reused.

Quantiles: one approximate pass brackets each wanted rank between two values
(its rank error is bounded, and the bracket is wider than the bound); a second
pass counts what lies below and groups only the values inside the bracket.
No row is sorted; a hot value is one row after the partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer.session import written

ACCURACY = 10000            # approximate ranks are off by at most n / ACCURACY
MARGIN = 3.0 / ACCURACY     # half width of a bracket, as a share of the rows
SMALL = int(4 / MARGIN)     # rows up to which a group is its own bracket
BROADCAST_ROWS = 10000      # per-group tables up to this many rows are broadcast


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a (written) table with one row per group; null keys match.

    The table is counted: up to ``BROADCAST_ROWS`` rows it is broadcast, so
    rows of a few hot groups are not shuffled; beyond, the planner decides."""
    small = per_group.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                             *[c for c in per_group.columns if c not in keys])
    if per_group.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(small, cond, "left").drop(*[f"_k_{k}" for k in keys])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   sums: Sequence[str], prefix: str = "cum_",
                   partitions: int | None = None, ahead: Sequence[str] = ()) -> DataFrame:
    """Add ``prefix+s`` = running sum of ``s`` within ``keys`` along ``order``
    (ascending, current row included), and ``next_c`` = the value of ``c`` (never null) in
    the row after it, null at the end.  Rows tied on every order key are
    summed in an arbitrary but consistent sequence; callers either
    pre-aggregate ties or put a unique key last in ``order``."""
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    by = [*[F.col(k) for k in keys], *order_cols]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    cut = written(ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "running")
    cut = cut.withColumn("_pid", F.shiftright("_at", 33))       # slice number, as written
    totals = cut.groupBy("_pid", *keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], *[F.min_by(c, "_at").alias(f"_f_{c}") for c in ahead])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select(
        "_pid", *keys, *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.lead(f"_f_{c}").over(Window.partitionBy(*keys).orderBy("_pid")).alias(f"_n_{c}") for c in ahead]), "offsets")
    within = (Window.partitionBy("_pid", *keys).orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = Window.partitionBy("_pid", *keys).orderBy("_at")
    local = cut.select("*", *[F.sum(s).over(within).alias(f"_l_{s}") for s in sums], *[F.lead(c).over(after).alias(f"_a_{c}") for c in ahead])
    out = attach(local, offsets, ["_pid", *keys])
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.col(f"_l_{s}")).alias(f"{prefix}{s}") for s in sums],
        *[F.coalesce(f"_a_{c}", f"_n_{c}").alias(f"next_{c}") for c in ahead])


def row_positions(df: DataFrame, order: Sequence[Column | str], name: str = "_pos",
                  partitions: int | None = None) -> DataFrame:
    """0-based global position of each row along ``order`` (which should be
    unique); the distributed replacement for ``row_number() OVER (ORDER BY)``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(one, [], order, ["_one"], prefix="_cum", partitions=partitions)
    return ranked.withColumn(name, F.col("_cum_one") - 1).drop("_one", "_cum_one")


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (``quantile_cont`` / pandas
    default) of each column in ``cols`` within ``keys``; NULLs ignored.

    Returns long rows: keys..., ``column``, ``n`` and ``q0..q{k-1}`` for the
    requested probabilities in order."""
    keys, cols = list(keys), list(cols)
    by = keys or ["_all"]
    # one group: a 0 that the planner does not fold, so that the one-row table is hash-joined
    base = df if keys else df.withColumn("_all", F.pmod(F.spark_partition_id(), F.lit(1)))
    base = base.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    edges = sorted({0.0, 1.0} | {min(1.0, max(0.0, p + s * MARGIN)) for p in probs for s in (-1, 1)})
    rough = written(base.groupBy(*by).agg(
        *[F.percentile_approx(f"_v{i}", edges, ACCURACY).alias(f"_e{i}") for i in range(len(cols))],
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(cols))]), "quantile-edges")

    def edge(i: int, p: float, side: int) -> Column:
        near = F.col(f"_e{i}")[edges.index(min(1.0, max(0.0, p + side * MARGIN)))]
        # a bracket of a few ranks is no bracket: small groups are taken whole
        return F.when(F.col(f"_n{i}") <= SMALL, F.col(f"_e{i}")[0 if side < 0 else len(edges) - 1]).otherwise(near)

    placed = attach(base, rough, by)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    below = placed.groupBy(*by).agg(*[F.count_if(F.col(f"_v{i}") < edge(i, probs[j], -1)).alias(f"_b{i}_{j}") for i, j in pairs])
    inside = F.filter(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_v{i}").alias("v"),
                 F.coalesce((F.col(f"_v{i}") >= edge(i, probs[j], -1)) & (F.col(f"_v{i}") <= edge(i, probs[j], 1)), F.lit(False)).alias("hit"))
        for i, j in pairs]), lambda s: s["hit"])
    values = (placed.select(*by, F.explode(inside).alias("s")).select(*by, "s.i", "s.j", "s.v")
              .groupBy(*by, "i", "j", "v").agg(F.count(F.lit(1)).alias("c")))
    # one row per group, column and probability: how many values lie below the bracket, and the wanted 0-based rank
    facts = attach(below, rough, by).select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_b{i}_{j}").alias("below"), F.col(f"_n{i}").alias("n"),
                 ((F.col(f"_n{i}") - 1) * F.lit(float(probs[j]))).alias("h")) for i, j in pairs])).alias("s")).select(*by, "s.*")
    upto = Window.partitionBy(*by, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(values.withColumn("_cum", F.sum("c").over(upto)), written(facts, "quantile-facts"), [*by, "i", "j"])
    last = F.col("below") + F.col("_cum")                       # ranks [last - c, last) hold v
    first = last - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col("v")))

    picked = ranked.groupBy(*by, "i", "j", "n", "h").agg(at(F.floor("h")).alias("lo"), at(F.ceil("h")).alias("hi"))
    frac = F.col("h") - F.floor("h")
    value = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")) \
             .otherwise(F.col("lo") + frac * (F.col("hi") - F.col("lo")))
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    out = (picked.select(*by, names.alias("column"), "n", "j", value.alias("q"))
           .groupBy(*by, "column", "n").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(probs))]))
    return out.select(*keys, "column", "n", *[f"q{j}" for j in range(len(probs))])


def exact_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide exact medians: keys..., ``<col>_median`` for each column."""
    long = exact_quantiles(df, keys, cols, [0.5])
    wide = long.groupBy(*keys).pivot("column", list(cols)).agg(F.first("q0"))
    return wide.select(*keys, *[F.col(c).alias(f"{c}_median") for c in cols])
