"""Document fingerprints by invertible Bloom lookup sketches (operator 13), in DataFrame functions only.

A document is the set of its paragraphs' digests (60 bits of MD5).  A paragraph is a line; a line longer than `LINE` code
points is cut at the first sentence end after each `LINE` (or after as many again).  A sketch has three subtables of `width`
cells; a digest is added to one cell of each: count, exclusive or of digests, exclusive or of check sums.  Sketches subtract
cell by cell, so what two versions share is gone; a cell that holds one digest then gives it away, which frees other
cells (peeling).  If cells are left after `ROUNDS` passes, the pair is tried again with `GROWTH` times the cells.

The fingerprint is the sketch of `WIDTH` cells a subtable, as text: `cell.count.digest.check` of the cells in use.  Likeness
is the share of common digests among all, from what peeling recovers; two texts without paragraphs are alike (1).

Whole texts are exchanged once, by document (MD5 of doc_id and text); half texts go from a document to the one they are put
into.  All sketching is done by document after an exchange of digests, without another.

Nulls: a null text is empty; null doc_ids come last in descending order.  Rows that share a doc_id are ordered by
the MD5 of doc_id and text.  A repeated row is followed by its copy, the last copy by the next row.  One row is followed by itself.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer.llm.workspace import materialize, only, positions

LINE = 256
PARAGRAPH = f"[^\\n]{{{LINE}}}[^.!?\\n]{{0,{LINE}}}[.!?]*|[^\\n]+"
TABLES, WIDTH, GROWTH, ROUNDS = 3, 8, 2, 4
#: Pairs of documents to a task.
PAIRS = 8_192


def _number(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: _number(F.md5(x.cast("binary")), 1, 15)))


def check(digest: Column) -> Column:
    """32 bits that tell a cell of one digest from a mixture."""
    return _number(F.md5(digest.cast("string").cast("binary")), 1, 8)


def cells(digest: Column, width: Column) -> Column:
    """The digest's cell in each subtable."""
    text = digest.cast("string")
    one, two = F.md5(text.cast("binary")), F.md5(F.concat(text, F.lit(":")).cast("binary"))
    places = [_number(one, 9, 15), _number(two, 1, 15), _number(two, 16, 15)]
    return F.array(*[p % width + t * width for t, p in enumerate(places)])


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, cell, n, digest, check) of `rows` (by, digest, sign); `by` holds `width`."""
    added = rows.select(*by, "sign", "digest", check(F.col("digest")).alias("check"), F.explode(cells(F.col("digest"), F.col("width"))).alias("cell"))
    return added.groupBy(*by, "cell").agg(F.sum("sign").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))


def peel(table: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(by, plus, minus, left): digests recovered with either sign from the cells `table`, and cells that stayed.

    Each pass takes the single digests of one subtable (where a digest has one cell, so none is taken twice) out of all
    their cells.  What is found is counted under cell -1.
    """
    zero = F.lit(0).cast("long")
    state = table.select(*by, "cell", "n", "digest", "check", zero.alias("plus"), zero.alias("minus"))
    fields = ("cell", "n", "digest", "check", "plus", "minus")

    def entry(*values):
        return F.struct(*[v.cast("long").alias(f) for v, f in zip(values, fields)])

    for step in range(TABLES * rounds):
        n, digest, width = F.col("n"), F.col("digest"), F.col("width")
        first = step % TABLES * width
        single = (F.col("cell") >= first) & (F.col("cell") < first + width) & (F.abs(n) == 1) & (F.col("check") == check(digest))
        kept = F.array(entry(*[F.col(f) for f in fields]))
        taken = F.transform(cells(digest, width), lambda c: entry(c, -n, digest, F.col("check"), zero, zero))
        found = F.array(entry(F.lit(-1), zero, zero, zero, (n == 1).cast("long"), (n == -1).cast("long")))
        moved = state.select(*by, F.explode(F.when(single, F.concat(kept, taken, found)).otherwise(kept)).alias("e")).select(*by, "e.*")
        state = (moved.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"),
                                                F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
                 .filter("cell = -1 or n <> 0 or digest <> 0 or check <> 0"))
    return state.groupBy(*by).agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left"))


def first_width(one: Column, other: Column) -> Column:
    """A power of two, with at least as many cells as both sets have digests: enough for most pairs, not for all."""
    digests = F.greatest(F.size(one) + F.size(other), F.lit(1))
    return F.greatest(F.lit(WIDTH), F.pow(F.lit(2), F.ceil(F.log2(digests / TABLES)))).cast("long")


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, kind, plus, minus) for `pairs` (pair, kind, one, other: arrays of digests, width): digests only in one, and only in the other.

    Every attempt subtracts the sketches of all pairs still open; those that do not peel go on with larger sketches.  A pair without difference has no row.
    """
    by, open_, out = ["pair", "kind", "width"], pairs, None
    while True:
        signed = open_.select(*by, F.explode(F.concat(
            F.transform("one", lambda x: F.struct(x.alias("digest"), F.lit(1).cast("long").alias("sign"))),
            F.transform("other", lambda x: F.struct(x.alias("digest"), F.lit(-1).cast("long").alias("sign"))))).alias("e")).select(*by, "e.*")
        tried = materialize(peel(sketch(signed, by).filter("n <> 0 or digest <> 0 or check <> 0"), by), "sketch-peeled")
        done = tried.filter("left = 0").select("pair", "kind", "plus", "minus")
        out = done if out is None else out.unionByName(done)
        failed = tried.filter("left > 0").select("pair", "kind", (F.col("width") * GROWTH).alias("width"))
        n = failed.count()
        if not n:
            return out
        open_ = pairs.drop("width").join(failed, ["pair", "kind"]).repartition(max(8, -(-n // PAIRS)), "pair")


def versions(documents: DataFrame) -> DataFrame:
    """One row for each distinct (document, document after it): pair, times, doc_id, n_chars, edited_sha256 and the paragraph
    digests of the text (own), of the edited text (edited) and of the next document (next)."""
    text = F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")))
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"), mark.alias("mark"))
    slim = docs.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"), F.max(F.length("text").cast("long")).alias("n_chars"))
    rows = positions(slim, F.desc_nulls_last("doc_id"), F.col("mark"), name="sketch-order")
    rows = materialize(rows.select("doc_id", "mark", "copies", "n_chars", "position"), "sketch-rows")
    last = rows.count() - 1
    after = rows.select(F.when(F.col("position") == 0, F.lit(last)).otherwise(F.col("position") - 1).alias("position"), F.col("mark").alias("next_mark"))
    asked = rows.join(after, "position").select(F.col("next_mark").alias("mark"), F.col("mark").alias("to"), "n_chars")
    texts = docs.select("mark", "text").dropDuplicates(["mark"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    sent = texts.join(asked, "mark").select(F.col("to").alias("mark"), F.left("text", half).alias("put"), paragraphs(F.col("text")).alias("next"))
    both = texts.join(rows, "mark").join(sent, "mark").withColumn("own", paragraphs(F.col("text")))
    one = F.struct((2 * F.col("position")).alias("pair"), F.lit(1).cast("long").alias("times"), F.col("put"), F.col("next"))
    copy = F.struct((2 * F.col("position") + 1).alias("pair"), (F.col("copies") - 1).alias("times"), F.left("text", half).alias("put"), F.col("own").alias("next"))
    each = both.select("doc_id", "n_chars", "text", "own", F.explode(F.when(F.col("copies") > 1, F.array(one, copy)).otherwise(F.array(one))).alias("e"))
    new = F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.col("e.put"))
    table = each.withColumn("new", new).select("e.pair", "e.times", "doc_id", "n_chars", F.unhex(F.sha2(F.col("new").cast("binary"), 256)).alias("sha"),
                                               "own", paragraphs(F.col("new")).alias("edited"), "e.next")
    return materialize(table, "sketch-versions")


def fingerprint_versions(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = versions(documents)
    tasks = max(8, -(-found.count() // PAIRS))
    pairs = found.select("pair", F.col("own").alias("one"), "edited", "next").repartition(tasks, "pair")
    pairs = pairs.select("pair", "one", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("edited").alias("other")), F.struct(F.lit(1).alias("kind"), F.col("next").alias("other")))).alias("e"))
    pairs = pairs.select("pair", "one", "e.*").withColumn("width", first_width(F.col("one"), F.col("other")))
    apart = differences(pairs).groupBy("pair").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("plus", "minus")])

    def likeness(k: int) -> Column:
        plus, minus = F.coalesce(f"plus{k}", F.lit(0)), F.coalesce(f"minus{k}", F.lit(0))
        union = F.size("own") + minus
        return F.when(union == 0, 1.0).otherwise((F.size("own") - plus) / F.greatest(union, F.lit(1)))

    # fingerprints: the documents' own columns go along as keys, so nothing is joined again
    kept = ["pair", "times", "doc_id", "n_chars", "sha", "near_edited", "near_next", "width"]
    dealt = (found.drop("next").repartition(tasks, "pair").join(apart, "pair", "left")
             .withColumns({"near_edited": likeness(0), "near_next": likeness(1), "width": F.lit(WIDTH).cast("long"), "sign": F.lit(1).cast("long")}))

    def side(digests: Column, number: int) -> Column:
        return F.transform(digests, lambda x: F.struct(F.lit(number).alias("side"), x.alias("digest")))

    lone = F.array(F.lit(0).cast("long"))  # side 2 keeps documents without paragraphs
    rows = dealt.select(*kept, "sign", F.explode(F.concat(side(F.col("own"), 0), side(F.col("edited"), 1), side(lone, 2))).alias("e")).select(*kept, "sign", "e.*")
    text = F.concat_ws(".", F.col("cell").cast("string"), F.lower(F.hex("n")), F.lower(F.hex("digest")), F.lower(F.hex("check")))
    listed = F.array_sort(F.collect_list(F.struct("cell", text.alias("text"))))  # at most TABLES * WIDTH
    written = sketch(rows, [*kept, "side"]).groupBy(*kept, "side").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "|").alias("print"))
    table = written.groupBy(*kept).agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("print"))), F.lit("")).alias(n) for s, n in enumerate(("fingerprint", "edited_fingerprint"))])
    # copies, in two steps that hold no long array
    many = 65_536
    table = table.withColumn("_many", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / many).cast("long"))))
    table = table.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(many).cast("long"), F.col("times") - F.col("_many") * many))))
    return table.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _sql_digests(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[^\\n]{{{LINE}}}[^.!?\\n]{{0,{LINE}}}[.!?]*|[^\\n]+'), lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))"


def _sql_fingerprint(digests: str) -> str:
    """A scalar subquery: the cells in use, in order."""
    places = ", ".join(f"('0x' || substr(md5(d::VARCHAR{more}), {first}, 15))::BIGINT % {WIDTH} + {t * WIDTH}" for t, (more, first) in enumerate((("", 9), (" || ':'", 1), (" || ':'", 16))))
    return f"""coalesce((SELECT string_agg(cell || '.' || lower(to_hex(n)) || '.' || lower(to_hex(x)) || '.' || lower(to_hex(c)), '|' ORDER BY cell) FROM (
  SELECT cell, count(*) AS n, bit_xor(d) AS x, bit_xor(('0x' || substr(md5(d::VARCHAR), 1, 8))::BIGINT) AS c
  FROM (SELECT d, unnest([{places}]) AS cell FROM (SELECT unnest({digests}) AS d)) GROUP BY cell)), '')"""


def _sql_near(other: str) -> str:
    return f"CASE WHEN len(a) + len({other}) = 0 THEN 1.0 ELSE len(list_intersect(a, {other}))::DOUBLE / (len(a) + len({other}) - len(list_intersect(a, {other}))) END"


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(doc_id::VARCHAR, '') || ':' || x)) AS i, count(*) OVER () AS n FROM t),
e AS (SELECT a.doc_id, a.x, b.x AS y, length(a.x) AS n_chars, substr(a.x, 1, length(a.x) - length(a.x) // 2) || substr(b.x, 1, length(a.x) // 2) AS z
      FROM o a JOIN o b ON b.i = a.i % a.n + 1),
d AS (SELECT *, {_sql_digests("x")} AS a, {_sql_digests("z")} AS b, {_sql_digests("y")} AS c FROM e)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(z) AS edited_sha256, {_sql_fingerprint("a")} AS fingerprint, {_sql_fingerprint("b")} AS edited_fingerprint,
       {_sql_near("b")} AS near_edited, {_sql_near("c")} AS near_next
FROM d
"""
