"""D2 / D5 stratified split and folds, D3 SMOTE, D4 class counts.

Split and folds are deterministic functions of the row key: a 32-bit hash of
``key || seed`` is cut at per-class quantiles, so every class keeps its
share exactly (to one row) without a window over a whole class.  The cut
table has one row per class; it is counted before it is broadcast
(``stats.attach``).

SMOTE finds k exact nearest neighbours inside the minority class without
pairing all points, by Voronoi cells around sampled pivots (``neighbours``).

Identical vectors are collapsed first (with a multiplicity), so a hot spot
of copies costs one row, not a quadratic block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer.functions import columns as C
from retainer.operators.neighbours import knn_within
from retainer.operators.stats import attach, exact_quantiles, row_positions, running_totals
from retainer.session import written


# D2 / D5 ---------------------------------------------------------------------------------------

def hash_score(key: str | Column, salt: str) -> Column:
    """Unsigned 32-bit hash: first 8 hex digits of md5(key || salt)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("bigint")


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) from the 53 high bits of a hash: the same for the same
    columns on any task layout and after any retry."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def class_cuts(df: DataFrame, label: str, score: str, probs: Sequence[float]) -> DataFrame:
    """Exact per-class quantiles of ``score`` (one row per class)."""
    return written(exact_quantiles(df, [label], [score], probs).drop("column", "n"), "class-cuts")


def stratified_split(df: DataFrame, label: str = "Exited", key: str = "CustomerId",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` = 'train' / 'test'; each class sends ``test_size`` of its
    rows (by hash order) to the test side."""
    x = df.withColumn("_h", hash_score(key, str(seed)))
    cuts = class_cuts(x, label, "_h", [1.0 - test_size]).withColumnRenamed("q0", "_cut")
    j = attach(x, cuts, [label])
    split = F.when(F.col("_h") <= F.col("_cut"), F.lit("train")).otherwise(F.lit("test"))
    return j.withColumn("split", split).drop("_h", "_cut")


def stratified_folds(df: DataFrame, label: str = "Exited", key: str = "CustomerId",
                     n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..n_folds-1: per-class quantile buckets of a second hash."""
    x = df.withColumn("_hf", hash_score(key, f"fold{seed}"))
    probs = [i / n_folds for i in range(1, n_folds)]
    cuts = class_cuts(x, label, "_hf", probs)
    j = attach(x, cuts, [label])
    fold = sum((F.when(F.col("_hf") > F.col(f"q{i}"), F.lit(1)).otherwise(F.lit(0))
                for i in range(len(probs))), F.lit(0))
    return j.withColumn("fold", fold.cast("int")).drop("_hf", *[f"q{i}" for i in range(len(probs))])


# D4 ----------------------------------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str = "Exited", stage: str | None = None) -> DataFrame:
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return out if stage is None else out.select(F.lit(stage).alias("stage"), label, "count")


# D3 ----------------------------------------------------------------------------------------------

CHUNK = 4096        # synthetic rows generated per task-sized chunk


def smote(df: DataFrame, features: Sequence[str], label: str = "Exited", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Oversample the minority class to the majority count.

    New row = x + u * (nbr - x), nbr one of x's k nearest minority
    neighbours drawn uniformly, u ~ U(0, 1); features are interpolated as
    doubles (0/1 dummies included).  The n_new synthetic rows are spread over
    the minority rows as evenly as possible (every row q or q + 1 times,
    the extra ones by hash order) instead of i.i.d. draws.  Returns the
    input rows plus the synthetic ones (other columns NULL, ``synthetic`` 1)."""
    # the input feeds several actions (class counts, k-NN, allocation, the
    # final union): cut its lineage once in the shared checkpoint folder
    df = written(df, "smote-input")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()   # one row per class
    base = df.withColumn("synthetic", F.lit(0))
    if len(counts) < 2:
        return base
    counts = sorted(counts, key=lambda r: (r["n"], r[label]))
    minority, n_min = counts[0][label], counts[0]["n"]
    n_new = counts[-1]["n"] - n_min
    if n_new == 0 or n_min < 2:
        return base
    kk = min(k, n_min - 1)
    q, rem = divmod(n_new, n_min)
    vec = F.array(*[F.col(f).cast("double") for f in features])
    uniq = (df.where(F.col(label) == minority).select(vec.alias("_v"))
              .groupBy("_v").agg(F.count(F.lit(1)).alias("_m")))
    uniq = row_positions(uniq.withColumn("_hv", F.xxhash64("_v")), [F.col("_hv"), F.col("_v")], "_id")
    uniq = written(uniq.drop("_hv"), "smote-points")
    slots = running_totals(uniq.select("_id", "_m"), [], [F.col("_id")], ["_m"], prefix="_cum")
    extra = F.greatest(F.least(F.col("_cum_m"), F.lit(rem)) - (F.col("_cum_m") - F.col("_m")), F.lit(0))
    alloc = slots.select("_id", "_m", (F.col("_m") * F.lit(q) + extra).alias("_c")).where(F.col("_c") > 0)
    # chunk large allocations so no single task generates an unbounded run
    chunks = alloc.select("_id", "_m", "_c", F.explode(F.sequence(
        F.lit(0), ((F.col("_c") - 1) / F.lit(CHUNK)).cast("bigint"))).alias("_chunk"))
    chunks = chunks.repartition("_id", "_chunk")
    draws = chunks.select("_id", "_m", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(CHUNK), F.col("_c") - F.col("_chunk") * CHUNK))).alias("_j"), "_chunk")
    salt = F.xxhash64("_id", "_chunk", "_j", F.lit(seed))
    draws = draws.select("_id", "_m", (F.pmod(salt, F.lit(kk)) + 1).cast("int").alias("nbr_rank"),
                         unit_hash("_id", "_chunk", "_j", F.lit(seed + 1)).alias("_u"))
    xv = uniq.select("_id", "_v")
    # rows with >= k other copies: every neighbour is a copy, the new row is x itself
    self_only = draws.where(F.col("_m") - 1 >= kk).join(xv, "_id").select(F.col("_v").alias("_x"))
    dim = len(features)
    nn = knn_within(uniq, kk, dim)
    nbv = nn.join(uniq.select(F.col("_id").alias("nbr_id"), F.col("_v").alias("_nv")), "nbr_id")
    gen = (draws.where(F.col("_m") - 1 < kk)
                .join(nbv, ["_id", "nbr_rank"]).join(xv, "_id"))
    interp = gen.select(F.zip_with(F.col("_v"), F.col("_nv"),
                                   lambda a_, b_: a_ + F.col("_u") * (b_ - a_)).alias("_x"))
    synth = self_only.unionByName(interp)
    cols = []
    for c in df.columns:
        dt = df.schema[c].dataType
        if c in features:
            cols.append(F.col("_x")[list(features).index(c)].cast(dt).alias(c)
                        if c in _float_features(df, features)
                        else F.col("_x")[list(features).index(c)].alias(c))
        elif c == label:
            cols.append(F.lit(minority).cast(dt).alias(c))
        else:
            cols.append(F.lit(None).cast(dt).alias(c))
    return base.unionByName(synth.select(*cols, F.lit(1).alias("synthetic")), allowMissingColumns=True)


def _float_features(df: DataFrame, features: Sequence[str]) -> set[str]:
    from pyspark.sql import types as T

    return {f for f in features if isinstance(df.schema[f].dataType, (T.DoubleType, T.FloatType))}
