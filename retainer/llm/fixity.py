"""Merkle fixity audit of WARC records (operator 3).

Pages become WARC resource records, in the order of (page_id, url, html), `per_file` records a file; a record's
leaf is the SHA-256 of its bytes' SHA-256, offset and length.  `fanout` neighbouring nodes are hashed, with the
range of offsets that they cover, into a node of the next level up to one root a file.  An audit compares the roots of
two replicas and descends level by level, joining only the children of nodes that differ, down to the damaged records.

A replica is a table of records (file_no, node, page_id, record_offset, record_length, hash) of its own; `node` is the
record's number in its file, below `per_file`.  Files and records that only one replica has are found like others.

Files hold a fixed number of records, so no key can make one large; only hashes and lengths are shuffled, not payloads.

Nulls: a null page_id, url or html is empty text in the record (null page_id sorts first).  Repeated rows are
records of their own.  An empty table gives no rows; against an empty replica every record is missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer.llm.workspace import materialize, only, positions

PER_FILE, FANOUT = 1024, 16


def record(url: Column, html: Column) -> Column:
    """The record's text: WARC header, payload and end."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def lot(column: Column, first: int) -> Column:
    """A number below 2**24 from the MD5 of a column, for fault injection."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), first, 6), 16, 10).cast("long")


def damaged(page_id: Column, html: Column) -> Column:
    """A replica's payload: one page in 101 starts with another byte, one in 211 is cut in half (null html: unchanged)."""
    return (F.when(lot(page_id, 1) % 101 == 7, F.concat(F.lit("\u0001"), html.substr(F.lit(2), F.length(html))))
            .when(lot(page_id, 1) % 211 == 3, html.substr(F.lit(1), F.floor(F.length(html) / 2).cast("int"))).otherwise(html))


def lost(page_id: Column) -> Column:
    """Whether a replica lacks the record: one page in 307."""
    return lot(page_id, 7) % 307 == 5


def late(page_id: Column) -> Column:
    """Whether a replica holds the record a byte late: one page in 251."""
    return lot(page_id, 13) % 251 == 11


def leaves(rows: DataFrame) -> DataFrame:
    """Lowest nodes (file_no, node, hash, first, last) of the records of a replica; `first` to `last` are the offsets covered."""
    last = F.col("record_offset") + F.col("record_length")
    return rows.select("file_no", "node", F.sha2(F.concat_ws(":", "hash", "record_offset", "record_length"), 256).alias("hash"),
                       F.col("record_offset").alias("first"), last.alias("last"))


def tree(lowest: DataFrame, per_file: int = PER_FILE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (file_no, node, hash, first, last) of the trees over `lowest`; the last has one node a file."""
    levels, width = [lowest.select("file_no", "node", "hash", "first", "last")], per_file
    while width > 1:
        width = -(-width // fanout)
        children = F.array_sort(F.collect_list(F.struct("node", "hash", "first", "last")))  # at most `fanout`
        text = F.transform(children, lambda x: F.concat_ws(":", x["node"], x["hash"], x["first"], x["last"]))
        up = (levels[-1].withColumn("up", F.floor(F.col("node") / fanout).cast("long")).groupBy("file_no", "up")
              .agg(F.sha2(F.concat_ws("|", text), 256).alias("hash"), F.min("first").alias("first"), F.max("last").alias("last"))
              .withColumnRenamed("up", "node"))
        levels.append(materialize(up, "fixity-level"))
    return levels


def audit(one: list[DataFrame], other: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves that differ: file_no, node, hash, other_hash (null where a replica has none)."""
    suspects = None
    for a, b in zip(reversed(one), reversed(other), strict=True):
        a, b = (x.select("file_no", "node", "hash") for x in (a, b))
        if suspects is not None:
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout).cast("long"))
                    .join(suspects, ["file_no", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "other_hash"), ["file_no", "node"], "full_outer")
        differing = materialize(both.filter(~F.col("hash").eqNullSafe(F.col("other_hash"))), "fixity-differing")
        suspects = differing.select("file_no", F.col("node").alias("parent"))
    return differing


def fixity_audit(kept: DataFrame, copy: DataFrame, per_file: int = PER_FILE, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: file_no, record_no, page_id, record_offset, record_length, sha256,
    replica_offset, replica_sha256, damage.

    `damage` is missing (the copy lacks it), extra (only the copy has it), changed (other bytes or length) or moved (the same
    bytes elsewhere); what a replica lacks is null, but page_id is that of either."""
    columns = ("file_no", "node", "page_id", "record_offset", "record_length", "hash")
    kept, copy = (materialize(x.select(*columns), f"fixity-{n}") for x, n in ((kept, "kept"), (copy, "copy")))
    found = audit(tree(leaves(kept), per_file, fanout), tree(leaves(copy), per_file, fanout), fanout).select("file_no", "node")
    other = copy.select("file_no", "node", *[F.col(c).alias(f"replica_{c}") for c in columns[2:]])
    rows = found.join(kept, ["file_no", "node"], "left").join(other, ["file_no", "node"], "left")
    same = (F.col("hash") == F.col("replica_hash")) & (F.col("record_length") == F.col("replica_record_length"))
    damage = (F.when(F.col("replica_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra")
              .when(same, "moved").otherwise("changed"))
    return rows.select("file_no", F.col("node").alias("record_no"), F.when(F.col("hash").isNull(), F.col("replica_page_id")).otherwise(F.col("page_id")).alias("page_id"),
                       "record_offset", "record_length", F.col("hash").alias("sha256"), F.col("replica_record_offset").alias("replica_offset"),
                       F.col("replica_hash").alias("replica_sha256"), damage.alias("damage"))


def replicas(pages: DataFrame, per_file: int = PER_FILE) -> tuple[DataFrame, DataFrame]:
    """Record tables of the pages and of a replica with seeded faults.

    The replica's files keep the rooms of the records: a lost one leaves a hole, a shorter one is followed by fill, a late one
    starts in the byte after its place."""
    source = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    text = record(F.col("url"), F.col("html"))
    copy = record(F.col("url"), damaged(F.col("page_id"), F.col("html")))
    slim = source.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_hash"),
                         F.octet_length(text).cast("long").alias("record_length"), F.sha2(text.cast("binary"), 256).alias("hash"),
                         F.octet_length(copy).cast("long").alias("copy_length"), F.sha2(copy.cast("binary"), 256).alias("copy_hash"))
    placed = positions(slim, F.col("page_id"), F.col("url"), F.col("payload_hash"), name="fixity-records")
    within = Window.partitionBy("file_no").orderBy("node")  # `per_file` rows
    rows = materialize(placed.withColumn("file_no", F.floor(F.col("position") / per_file).cast("long"))
                       .withColumn("node", F.col("position") % per_file)
                       .withColumn("record_offset", F.sum("record_length").over(within) - F.col("record_length"))
                       .select("file_no", "node", "page_id", "record_offset", "record_length", "hash", "copy_length", "copy_hash"), "fixity-rows")
    return (rows.drop("copy_length", "copy_hash"),
            rows.filter(~lost(F.col("page_id")))
            .select("file_no", "node", "page_id", (F.col("record_offset") + late(F.col("page_id")).cast("long")).alias("record_offset"),
                    F.col("copy_length").alias("record_length"), F.col("copy_hash").alias("hash")))


def seeded_audit(pages: DataFrame, per_file: int = PER_FILE, fanout: int = FANOUT) -> DataFrame:
    """`fixity_audit` of the pages' records against a replica with seeded faults."""
    return fixity_audit(*replicas(pages, per_file), per_file, fanout)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, url AS u0, html AS h0,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 6))::BIGINT AS l1, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 7, 6))::BIGINT AS l7,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 13, 6))::BIGINT AS l13 FROM pages),
c AS (SELECT *, CASE WHEN h0 IS NULL THEN html WHEN l1 % 101 = 7 THEN chr(1) || substr(html, 2) WHEN l1 % 211 = 3 THEN substr(html, 1, length(html) // 2) ELSE html END AS html2 FROM p),
r AS (SELECT *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS a,
        concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(html2), chr(13), chr(10), chr(13), chr(10), html2, chr(13), chr(10), chr(13), chr(10)) AS b FROM c),
n AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, u0 NULLS FIRST, sha256(html)) - 1 AS position, strlen(a)::BIGINT AS record_length FROM r),
o AS (SELECT *, position // {PER_FILE} AS file_no, position % {PER_FILE} AS record_no FROM n),
t AS (SELECT *, (sum(record_length) OVER (PARTITION BY file_no ORDER BY record_no) - record_length)::BIGINT AS record_offset,
        sha256(a) AS sha, CASE WHEN l7 % 307 = 5 THEN NULL ELSE sha256(b) END AS sha2, l13 % 251 = 11 AS late FROM o)
SELECT file_no::BIGINT AS file_no, record_no::BIGINT AS record_no, page_id, record_offset, record_length, sha AS sha256, CASE WHEN sha2 IS NOT NULL THEN record_offset + late::BIGINT END AS replica_offset,
       sha2 AS replica_sha256, CASE WHEN sha2 IS NULL THEN 'missing' WHEN sha2 <> sha THEN 'changed' ELSE 'moved' END AS damage
FROM t WHERE sha2 IS NULL OR sha2 <> sha OR late
"""
