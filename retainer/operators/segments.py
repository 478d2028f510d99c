"""Customer segmentation -- k-means on standardised features, PCA,
cluster naming, and the rule segments used at scoring time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import features as FE
from retainer.operators import kmeans as KM
from retainer.session import written

R6 = C.bround6


def scaled_vectors(df: DataFrame, cols: Sequence[str] = S.CLUSTER_FEATURES,
                   keep: Sequence[str] = ("CustomerId",), out: str = "features") -> DataFrame:
    """B13 population-std scaling, assembled into one vector column."""
    from pyspark.ml.feature import VectorAssembler

    z = FE.standardize(df, cols, keep=keep)
    zcols = [f"{c}_z" for c in cols]
    z = z.na.fill(0.0, subset=zcols)   # constant column -> 0 after scaling
    return VectorAssembler(inputCols=zcols, outputCol=out).transform(z).select(*keep, out)


# C1 / C2 ------------------------------------------------------------------------------------------

def _arrays(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    # a small table of many passes: one part a core, where the planner would leave a few by its bytes
    parts = vectors.sparkSession.sparkContext.defaultParallelism
    return written(vectors.select(vector_to_array("features").alias("v")).repartition(parts), "cluster-vectors")


def elbow_curve(vectors: DataFrame, ks: Sequence[int] = range(2, 11), n_init: int = 10,
                seed: int = 42) -> DataFrame:
    """(k, inertia) for each k, best of ``n_init`` starts; all fits share their passes over the vectors."""
    best = KM.best_of(KM.fit_runs(_arrays(vectors), list(ks), [seed + i for i in range(n_init)]))
    rows = [(int(k), float(best[k].inertia)) for k in ks if k in best]
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double")


def fit_segments(vectors: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42) -> KM.Clusters:
    """The clusters of least inertia among ``n_init`` starts, numbered in the order of their centres."""
    return KM.best_of(KM.fit_runs(_arrays(vectors), [k], [seed + i for i in range(n_init)]))[k]


def assign_segments(model: KM.Clusters, vectors: DataFrame) -> DataFrame:
    """Adds ``CustomerSegment`` (cluster id)."""
    from pyspark.ml.functions import vector_to_array

    return vectors.withColumn("CustomerSegment", KM.nearest(vector_to_array("features"), model.centres))


# C3 ------------------------------------------------------------------------------------------------

def segment_profile(df: DataFrame, segment: str, cols: Sequence[str]) -> DataFrame:
    """Mean of every listed column per segment (one group-by)."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"),
                                   *[R6(F.avg(c)).alias(f"avg_{c}") for c in cols])


# C4 ------------------------------------------------------------------------------------------------

def name_clusters(profile: DataFrame, segment: str = "CustomerSegment",
                  fixed: bool = False) -> DataFrame:
    """Cluster id -> segment name.

    ``fixed``: the training script's map (0 YP, 1 ES, 2 HVC, 3 ARS), which
    depends on arbitrary cluster numbering.  Default: a stable rule on the
    cluster means (4 clusters) -- oldest = At-Risk Seniors, youngest = Young
    Professionals, of the other two the higher mean balance = High-Value
    Clients, the last = Established Savers.  ``profile`` has one row per
    cluster with ``avg_Age`` and ``avg_Balance``."""
    if fixed:
        m = F.create_map(*[x for k, v in S.CLUSTER_NAMES.items() for x in (F.lit(k), F.lit(v))])
        return profile.select(segment, m[F.col(segment)].alias("SegmentName"))
    from pyspark.sql import Window

    w_age = Window.orderBy(F.col("avg_Age").asc(), F.col(segment))   # over k (= 4) cluster rows
    ranked = profile.select(segment, "avg_Age", "avg_Balance",
                            F.row_number().over(w_age).alias("age_rank"))
    k = profile.count()
    mid = ranked.where((F.col("age_rank") > 1) & (F.col("age_rank") < k))
    w_bal = Window.orderBy(F.col("avg_Balance").desc(), F.col(segment))
    mid = mid.select(segment, F.row_number().over(w_bal).alias("bal_rank"))
    named = ranked.join(mid, segment, "left").select(
        segment,
        F.when(F.col("age_rank") == 1, F.lit(S.YP))
         .when(F.col("age_rank") == k, F.lit(S.ARS))
         .when(F.col("bal_rank") == 1, F.lit(S.HVC))
         .otherwise(F.lit(S.ES)).alias("SegmentName"))
    return named


def assign_least(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row in a one-to-one assignment of least total cost; rows are at most as many as columns.

    Rows enter one by one; each enters by the cheapest chain of reassignments, found with
    prices on rows and columns that keep reduced costs from going below 0."""
    rows, cols = len(cost), len(cost[0]) if cost else 0
    holder, row_price, col_price = [-1] * cols, [0.0] * rows, [0.0] * cols
    for new in range(rows):
        dist, via, done = [float("inf")] * cols, [-1] * cols, [False] * cols
        row, base, last = new, 0.0, -1
        while True:
            for j in range(cols):
                through = base + cost[row][j] - row_price[row] - col_price[j]
                if not done[j] and through < dist[j]:
                    dist[j], via[j] = through, last
            last = min((j for j in range(cols) if not done[j]), key=lambda j: (dist[j], j))
            done[last], base = True, dist[last]
            if holder[last] < 0:
                break
            row = holder[last]
        for j in range(cols):
            if done[j] and holder[j] >= 0:
                row_price[holder[j]] += base - dist[j]
                col_price[j] -= base - dist[j]
        row_price[new] += base
        while last >= 0:
            before = via[last]
            holder[last] = holder[before] if before >= 0 else new
            last = before
    place = {r: j for j, r in enumerate(holder) if r >= 0}
    return [place[i] for i in range(rows)]


def carry_names(profile: DataFrame, former: DataFrame, scale: Sequence[float], cols: Sequence[str],
                segment: str = "CustomerSegment") -> DataFrame:
    """Names of a refit's clusters, whatever their number: each takes the name of the former cluster it is
    matched to, one to one, with the least sum of squared distances of the means over ``scale``.

    Both tables have one row a cluster (``segment``, ``avg_<col>``; ``former`` also ``SegmentName``).
    Clusters beyond the former ones are named ``Segment <id>``; names whose cluster is gone fall away.  Means that are null count as 0."""
    def means(table: DataFrame, *first: str) -> list:
        return sorted(table.select(*first, *[F.coalesce(F.col(f"avg_{c}"), F.lit(0.0)).alias(f"avg_{c}") for c in cols]).collect())

    new, old = means(profile, segment), means(former, segment, "SegmentName")      # one row a cluster each
    def far(a, b) -> float:
        return sum(((x - y) / s) ** 2 if s else 0.0 for x, y, s in zip(a[1:], b[2:], scale, strict=True))

    names = {r[0]: f"Segment {r[0]}" for r in new}
    if len(new) <= len(old):
        names |= {new[i][0]: old[j][1] for i, j in enumerate(assign_least([[far(a, b) for b in old] for a in new]))}
    else:
        names |= {new[j][0]: old[i][1] for i, j in enumerate(assign_least([[far(a, b) for a in new] for b in old]))}
    kind = profile.schema[segment].dataType.simpleString()
    return profile.sparkSession.createDataFrame(sorted(names.items()), f"{segment} {kind}, SegmentName string")


# C5 ------------------------------------------------------------------------------------------------

def pca_projection(vectors: DataFrame, k: int = 2, keep: Sequence[str] = ("CustomerId",)) -> DataFrame:
    """First ``k`` principal components of the scaled vectors (signs arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    arr = vector_to_array(F.col("pcs"))
    return model.transform(vectors).select(*keep, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


# C6 / C7 live in functions.columns.rule_segment ------------------------------------------------------

def kmeans_segments(df: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, former: DataFrame | None = None) -> DataFrame:
    """C2 + C3 + C4 end to end: cluster the scaled features, profile the
    clusters, name them; returns CustomerId, CustomerSegment, SegmentName.

    ``former``: an earlier run's profile with its names, over ``S.CLUSTER_FEATURES``: clusters then
    keep the names of those they match (``carry_names``).

    The profile columns travel with the vectors, so no join back to the
    customer table is needed; the name table has k rows (broadcast)."""
    cols = list(S.CLUSTER_FEATURES) if former is not None else ["Age", "Balance"]
    vec = written(scaled_vectors(df, keep=("CustomerId", *cols)), "segment-vectors")
    model = fit_segments(vec, k, n_init, seed)
    labelled = assign_segments(model, vec)
    prof = segment_profile(labelled, "CustomerSegment", cols)
    if former is None:
        names = name_clusters(prof)
    else:
        spread = vec.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
        names = carry_names(prof, former, [spread[c] or 0.0 for c in cols], cols)
    return labelled.join(F.broadcast(names), "CustomerSegment").select(
        "CustomerId", "CustomerSegment", "SegmentName")
