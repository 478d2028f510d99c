"""Prefix trie of conversations, rolled up by centroid decomposition (operator 12).

A conversation c is rebuilt as the first h = crc32(c) % 9 turns of conversation c - c % 5 and its own turns after its first
h.  A node of depth d is a distinct sequence of first d rebuilt turns; it is named by its smallest member and its
depth.  `paths` holds the node of every (conversation, depth), found by grouping on the running exclusive or of 120-bit
hashes of (depth, role, text); texts themselves are shuffled only to order the rows.

Totals over subtrees come from a centroid decomposition of the parent edges.  A component gives up its centroid, the
deepest node whose subtree holds half of it; the centroid's total within the component is final for it and is added along
the path up to the component's top; what hangs below its children, and what is left above, are components of half the size.
Components above `limit` nodes are split by joins on (conversation, depth); smaller ones are finished inside tasks, many
to a task.

Nulls: a null role or text is empty; a null turn comes first; rows of a null conv_id take no part, as they have no number.
Turns that tie are ordered by role, then text; repeated rows are turns of their own.  `c % 5` has the sign of c, as in SQL.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer.llm.conversations import numbered, sequenced, typed
from retainer.llm.workspace import materialize

FAMILY, SHARED = 5, 9
#: Components up to this many nodes are finished in one task.
LIMIT = 20_000
#: A right-hand row that meets more than 1/HOT of the left-hand rows is broadcast; there are fewer than HOT of them.
HOT = 2_000
BLOCK, CHUNK = 1_024, 4_096


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "left") -> DataFrame:
    """`left` joined with `right` (unique in `on`), of which column `rows` counts the left rows it meets.

    Rows of `right` that meet more than 1/HOT of all are fewer than HOT, so they are broadcast and their left rows stay
    where they are; no key of the shuffled join holds more than that share.
    """
    crowd = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("all")).first()["all"] / HOT
    hot = right.filter(F.col(rows) > crowd).withColumn("_hot", F.lit(True))
    values = [c for c in right.columns if c not in on]
    tagged = left.join(F.broadcast(hot), on, "left")
    found = tagged.filter("_hot").drop("_hot")
    rest = tagged.filter("_hot is null").drop("_hot", *values).join(right.filter(F.col(rows) <= crowd), on, how)
    return found.unionByName(rest)


def running(rows: DataFrame, by: list[str], at: str, columns: list[str], total, plus, backward: bool = False) -> DataFrame:
    """`columns` replaced by their running `total` along `at` (from the end if `backward`) within `by`.

    Windows hold one block of `at` values; totals of earlier blocks, one row a block, are put on top by `plus`.
    """
    order = F.col(at).desc() if backward else F.col(at).asc()
    block = F.floor(F.col(at) / BLOCK).cast("long")
    cut = rows.withColumn("_block", block)
    sums = cut.groupBy(*by, "_block").agg(*[total(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy(F.col("_block").desc() if backward else F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(*by, "_block", *[total(f"_{c}").over(before).alias(f"_{c}") for c in columns]).filter(F.col(f"_{columns[0]}").isNotNull())
    within = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({c: total(c).over(within) for c in columns})
    return (inside.join(earlier, [*by, "_block"], "left")
            .withColumns({c: plus(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0))) for c in columns}).drop("_block", *[f"_{c}" for c in columns]))


def _hash(digits: int) -> Column:
    """60 bits of the SHA-256 of (depth, turn)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"), 256), 1 + digits, 15), 16, 10).cast("long")


# paths and nodes -------------------------------------------------------------------------------------

def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns: conv, depth from 1, digest, bytes; lengths: conv, length)."""
    rows = typed(conversations).filter("conv_id is not null").fillna("", ["role", "text"])
    turn = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ordered = sequenced(rows, {"conv": F.col("conv_id"), "digest": turn, "bytes": F.octet_length("text").cast("long")}, "trie-rows")
    turns = materialize(numbered(ordered).select("conv", "idx", "digest", "bytes"), "trie-turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = F.col("conv") - F.col("conv") % FAMILY
    plan = (sizes.withColumn("base", base).withColumn("h", shared_turns(F.col("conv")))
            .join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
            .withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))))
    plan = materialize(plan.select("conv", "base", "n", "h", "k"), "trie-plan")
    heads = turns.filter(F.col("idx") < SHARED - 1).withColumnRenamed("conv", "base")
    taken = plan.filter("k > 0").select("conv", "base", "k").join(heads, "base").filter("idx < k").select("conv", (F.col("idx") + 1).alias("depth"), "digest", "bytes")
    kept = turns.filter(F.col("idx") >= shared_turns(F.col("conv")))
    kept = spread_join(kept, plan.filter("n > h").select("conv", "h", "k", (F.col("n") - F.col("h")).alias("own")), ["conv"], "own")
    kept = kept.select("conv", (F.col("k") + F.col("idx") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    lengths = plan.select("conv", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return taken.unionByName(kept), lengths


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths: conv, depth, node, bytes; nodes: node, depth, parent, n_convs, bytes; lengths).  The root has depth 0."""
    turns, lengths = rebuilt(conversations)
    lengths = materialize(lengths, "trie-lengths")
    keyed = turns.select("conv", "depth", "bytes", _hash(0).alias("a"), _hash(15).alias("b"))
    steps = materialize(running(keyed, ["conv"], "depth", ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y)), "trie-steps")
    named = materialize(steps.groupBy("depth", "a", "b").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")), "trie-names")
    placed = spread_join(steps, named, ["depth", "a", "b"], "n_convs").select("conv", "depth", "node", "bytes", "n_convs")
    top = lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = top.select(F.col("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    root_path = lengths.select("conv", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(top.select("node")))  # one row
    paths = materialize(placed.unionByName(root_path.withColumns({"bytes": F.lit(0).cast("long"), "n_convs": F.lit(0).cast("long")})), "trie-paths")
    own = paths.filter("node = conv and depth > 0")
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = own.join(above, ["conv", "depth"]).select("node", "depth", "parent", "n_convs", "bytes").unionByName(root)
    return paths.select("conv", "depth", "node", "bytes"), materialize(nodes, "trie-nodes"), lengths


# centroid decomposition --------------------------------------------------------------------------------

def split(open_: DataFrame, paths: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round on components of any size: (finished centroids: node, depth, values; what is left, with new components).

    `open_` has node, depth, top, top_depth (its component), the nodes' own `values` and what was added so far (`add_...`).
    A node's total within its component is summed over the conversations that pass it: each gives what it owns
    (nodes that bear its name) from that depth down, within the component.
    """
    comp, sums = ["top", "top_depth"], ["size", *values]
    owned = open_.select("node", "depth", *comp, F.lit(1).cast("long").alias("size"), *values)
    suffix = running(owned, ["node", *comp], "depth", sums, F.sum, lambda x, y: x + y, backward=True)
    # the first owned node of a conversation in the component: its suffix goes to all nodes above it, up to the top
    first = suffix.groupBy("node", *comp).agg(F.min("depth").alias("first"), *[F.max_by(c, -F.col("depth")).alias(c) for c in sums])
    upward = (first.filter("first > top_depth").withColumn("depth", F.explode(F.sequence("top_depth", F.col("first") - 1))).withColumnRenamed("node", "conv")
              .join(paths.select("conv", "depth", "node"), ["conv", "depth"]))
    totals = (suffix.select("node", "depth", *comp, *sums).unionByName(upward.select("node", "depth", *comp, *sums))
              .groupBy("node", "depth", *comp).agg(*[F.sum(c).alias(c) for c in sums]))
    counts = owned.groupBy(*comp).agg(F.count("*").alias("nodes"))
    half = totals.join(counts, comp).filter("2 * size >= nodes")
    centroids = materialize(half.groupBy(*comp).agg(F.max("nodes").alias("nodes"), F.max_by(F.struct("node", *values), "depth").alias("x"), F.max("depth").alias("x_depth"))
                            .select(*comp, "nodes", F.col("x.node").alias("x"), "x_depth", *[F.col(f"x.{v}").alias(f"x_{v}") for v in values]), "trie-centroids")
    # along the path from the centroid's parent to the top
    way = (centroids.filter("x_depth > top_depth").withColumn("depth", F.explode(F.sequence("top_depth", F.col("x_depth") - 1))).withColumn("conv", F.col("x"))
           .join(paths.select("conv", "depth", "node"), ["conv", "depth"]).select("node", "depth", *[F.col(f"x_{v}") for v in values]))
    added = open_.join(way, ["node", "depth"], "left").withColumns({f"add_{v}": F.col(f"add_{v}") + F.coalesce(F.col(f"x_{v}"), F.lit(0)) for v in values})
    added = added.drop(*[f"x_{v}" for v in values])
    # conversations that own nodes below the centroid: their path passes it, and the child there is the new top
    owner = open_.groupBy("node", *comp).agg(F.count("*").alias("_rows"), F.max("depth").alias("_deepest"))
    owner = spread_join(owner.withColumnRenamed("node", "conv"), centroids.select(*comp, "nodes", "x", "x_depth"), comp, "nodes")
    owner = owner.filter("_deepest > x_depth")
    at = paths.select("conv", F.col("depth").alias("x_depth"), F.col("node").alias("x"))
    child = paths.select("conv", (F.col("depth") - 1).alias("x_depth"), F.col("node").alias("child"))
    below = owner.join(at, ["conv", "x_depth", "x"], "left_semi").join(child, ["conv", "x_depth"]).select(F.col("conv").alias("node"), *comp, "child", F.col("x_depth").alias("below"), "_rows")
    rest = spread_join(added, materialize(below, "trie-below"), ["node", *comp], "_rows").drop("_rows")
    gone = centroids.select(F.col("x").alias("node"), F.col("x_depth").alias("depth"), *[f"x_{v}" for v in values])
    rest = materialize(rest.join(gone, ["node", "depth"], "left"), "trie-rest")
    done = rest.filter(f"x_{values[0]} is not null").select("node", "depth", *[(F.col(f"x_{v}") + F.col(f"add_{v}")).alias(v) for v in values])
    moved = F.coalesce(F.col("depth") > F.col("below"), F.lit(False))
    left = rest.filter(f"x_{values[0]} is null").select(
        *[F.when(moved, F.col("child")).otherwise(F.col("top")).alias(c) if c == "top" else
          F.when(moved, F.col("below") + 1).otherwise(F.col("top_depth")).alias(c) if c == "top_depth" else F.col(c) for c in open_.columns])
    return done, left


def decompose(parent: list[int], comp: list, values: list[list[int]], added: list[list[int]]) -> list[list[int]]:
    """Subtree totals of whole components held as lists; `parent` is -1 at a top, and smaller than its child elsewhere."""
    n, k = len(parent), range(len(values))
    total, live = [[0] * n for _ in k], list(range(n))
    comp = list(comp)
    while live:
        size, sums = dict.fromkeys(live, 1), [{i: v[i] for i in live} for v in values]
        for i in reversed(live):
            p = parent[i]
            if p >= 0 and comp[p] == comp[i]:
                size[p] += size[i]
                for s in sums:
                    s[p] += s[i]
        whole = {}
        for i in live:
            whole.setdefault(comp[i], size[i])  # the top comes first
        centre = {}
        for i in reversed(live):
            if 2 * size[i] >= whole[comp[i]]:
                centre.setdefault(comp[i], i)
        for c, x in centre.items():
            p = parent[x]
            while p >= 0 and comp[p] == c:
                for j in k:
                    added[j][p] += sums[j][x]
                p = parent[p]
            for j in k:
                total[j][x] = added[j][x] + sums[j][x]
        old, gone = {i: comp[i] for i in live}, set(centre.values())
        for i in live:
            p = parent[i]
            if p >= 0 and p in old and old[p] == old[i]:
                comp[i] = ("below", i) if p in gone else comp[p]
        for x in gone:
            comp[x] = None
        live = [i for i in live if i not in gone]
    return total


def _finisher(values: list[str]):
    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("depth", "ascending"), ("node", "ascending")])
        col = {n: table.column(n).to_pylist() for n in table.column_names}
        place = {x: i for i, x in enumerate(zip(col["node"], col["depth"]))}
        comp = list(zip(col["top"], col["top_depth"]))
        parent = [-1 if (u, d) == c else place[p, d - 1] for u, d, p, c in zip(col["node"], col["depth"], col["parent"], comp)]
        total = decompose(parent, comp, [col[v] for v in values], [col[f"add_{v}"] for v in values])
        return pa.table({"node": table.column("node"), "depth": table.column("depth"), **{v: pa.array(t, pa.int64()) for v, t in zip(values, total)}})

    return finish


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], limit: int = LIMIT) -> DataFrame:
    """(node, depth, values summed over the subtree) of `nodes` (node, depth, parent, values)."""
    top = nodes.filter("depth = 0").select(F.col("node").alias("top"), F.lit(0).cast("long").alias("top_depth"))  # the root
    open_ = nodes.select("node", "depth", "parent", *values).crossJoin(F.broadcast(top)).withColumns({f"add_{v}": F.lit(0).cast("long") for v in values})
    ready, out = None, None
    while True:
        sizes = materialize(open_.groupBy("top", "top_depth").agg(F.count("*").alias("_nodes")), "trie-sizes")
        largest = sizes.agg(F.max("_nodes")).first()[0] or 0
        whole = spread_join(open_, sizes, ["top", "top_depth"], "_nodes") if largest > limit else open_
        small = whole.filter(F.col("_nodes") <= limit).drop("_nodes") if largest > limit else whole
        ready = small if ready is None else ready.unionByName(small)
        if largest <= limit:
            break
        done, open_ = split(materialize(whole.filter(F.col("_nodes") > limit).drop("_nodes"), "trie-open"), paths, values)
        out = done if out is None else out.unionByName(done)
    ready = materialize(ready, "trie-ready")
    tasks = max(1, -(-ready.count() // limit))
    schema = "node long, depth long, " + ", ".join(f"{v} long" for v in values)
    finished = ready.groupBy(F.pmod(F.xxhash64("top", "top_depth"), F.lit(tasks)).alias("_task")).applyInArrow(_finisher(values), schema)
    return finished if out is None else finished.unionByName(out)


# the table ---------------------------------------------------------------------------------------------

def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined chunks of each node; chunks come in order, and one batch is held."""
    at, sha = None, None

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends_sha256"])

    for batch in batches:
        rows = []
        for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
            if at != (node, depth):
                if at:
                    rows.append((*at, sha.hexdigest()))
                at, sha = (node, depth), hashlib.sha256(text.encode())
            else:
                sha.update(("," + text).encode())
        yield table(rows)
    yield table([(*at, sha.hexdigest())] if at else [])


def ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of nodes where conversations end."""
    last = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    chunks = last.groupBy("node", "depth", F.floor(F.col("conv") / CHUNK).cast("long").alias("chunk")).agg(ids.alias("ids"))  # at most CHUNK ids
    return (chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk")
            .mapInArrow(_hash_lists, "node long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, nodes, lengths = trie(conversations)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    valued = materialize(nodes.join(children, ["node", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-valued")
    totals = rollup(valued, paths, ["n_leaves", "saved_tokens"], limit)
    table = valued.drop("n_leaves", "saved_tokens").join(totals, ["node", "depth"]).join(ends(paths, lengths), ["node", "depth"], "left")
    return table.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


# crc32 has no DuckDB function: one step a bit over the decimal's ASCII bytes (fixed value: the reflected polynomial)
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
                  sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS bytes
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % {FAMILY} AS base, {_CRC} % {SHARED} AS h FROM t GROUP BY c),
k AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n b ON b.c = n.base),
r AS (SELECT k.c, t.i + 1 AS d, x, bytes FROM k JOIN t ON t.c = k.base AND t.i < k.h
      UNION ALL SELECT k.c, k.k + t.i - k.h + 1, x, bytes FROM k JOIN t ON t.c = k.c AND t.i >= k.h
      UNION ALL SELECT c, 0, '', 0 FROM k),
s AS (SELECT c, d, bytes, list(x) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p, max(d) OVER (PARTITION BY c) AS m FROM r),
v AS (SELECT d, p, min(c) AS node, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = m) AS ids FROM s GROUP BY d, p),
w AS (SELECT s.c, s.d, v.node FROM s JOIN v ON v.d = s.d AND v.p = s.p),
f AS (SELECT v.*, w.node AS parent FROM v LEFT JOIN w ON w.c = v.node AND w.d = v.d - 1),
g AS (SELECT f.*, (SELECT count(*) FROM f ch WHERE ch.parent = f.node AND ch.d = f.d + 1) AS n_children FROM f),
u AS (SELECT w.node, w.d, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved FROM g JOIN w ON w.c = g.node AND w.d <= g.d GROUP BY ALL)
SELECT g.node::BIGINT AS conv_id, g.d::BIGINT AS depth, g.parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN u ON u.node = g.node AND u.d = g.d
"""
