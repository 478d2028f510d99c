"""Conversation structure repair with scalar big-integer weights (operator 11).

Each edit of a cheapest repair is an edge of a DAG whose nodes are (rows used, grammar state).  An edge weighs one integer:
its cost above a fixed number of base-8 digits, and its audit letter at the digit of its place in the audit.  Unused
digits at the end stay zero, so of two audits of one cost the ASCII-least is the smaller integer, and a plain
integer minimum at every node decides cost and audit together.  (Two paths of equal cost into one node never
have audits of which one begins the other, as the rest would be insertions, which cost.)

Grammar of role initials: `(s?(ua)+)?`, as states 0 (start), 1 (after s), 2 (after u), 3 (after a); 0 and 3 may end.

Rows are put in order by one range sort; a conversation is cut into segments of `SEGMENT` rows, each solved alone from every
state it may start in, and segments are joined `FAN` at a time.  So no conversation, however long, is held in one task;
only what the contract keeps whole is: its audit, and its SHA-256, which is fed row by row from a sorted partition.

Nulls: a null conv_id, turn, role or text is read as one space (a null text is blank; null conv_ids are one conversation).
Rows of one turn are ordered by role, then text.  Repeated rows are rows of their own (the later ones duplicates).  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer.llm.conversations import BLANK, key, numbered, sequenced, typed
from retainer.llm.workspace import materialize

SEGMENT, FAN = 64, 16
WHITE = " \t\n\x0b\x0c\r"
#: Letters of the audit in ASCII order: delete, insert, keep, rerole.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
DELETE, INSERT, REROLE, LATE = 3, 2, 2, 1
STATES, ENDS = range(4), (0, 3)
#: What a role does to the grammar state, and the role that can be put into each state.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
PUT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
NAME = {"u": "user", "a": "assistant"}


# rows ----------------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with seeded faults: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text,
    2 removes its `[.!?]`, 3 repeats it, 4 makes its role `user`."""
    lot = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    rows = typed(conversations).fillna(BLANK, ["role", "text"]).withColumn("_lot", lot).filter("_lot <> 0")
    rows = rows.withColumn("text", F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_lot", "_n")


def _fault(text: Column) -> Column:
    """b (blank), t (truncated) or a space."""
    end = F.expr(f"rtrim('{WHITE.encode('unicode_escape').decode().replace(chr(92) + 'x', chr(92) + 'u00')}', text)")
    return F.when(end == "", "b").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise(" ")


def coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows written in order: conv (key), seq, turn, role, text, initial (s, u, a or x); their codes: conv, seq, turn, idx, initial, fault (b, d, t or a space))."""
    first = F.substring("role", 1, 1)
    ordered = sequenced(rows, {"conv": key(), "turn": F.col("turn"), "role": F.col("role"), "text": F.col("text"),
                               "initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"), "fault": _fault(F.col("text")),
                               "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))}, "repair-rows")
    # duplicates: what is not the first of its (conversation, role, text); both sides of the join have one row a seq
    firsts = ordered.filter("fault <> 'b'").groupBy("conv", "same").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    slim = ordered.select("conv", "seq", "turn", "initial", "fault").join(firsts, "seq", "left")
    fault = F.when((F.col("fault") == "b") | F.col("_first"), F.col("fault")).otherwise("d")
    return ordered, materialize(numbered(slim.select("conv", "seq", "turn", "initial", fault.alias("fault"))), "repair-codes")


# the DAG -------------------------------------------------------------------------------------------

def _letters(weight: int, width: int, n: int) -> tuple[int, str]:
    """(cost, audit) of a weight with `width` digits of which `n` are used."""
    digits = (weight & ((1 << 3 * width) - 1)) >> 3 * (width - n)
    return weight >> 3 * width, (oct(digits)[2:] if n else "").translate(str.maketrans("1234", "DIKR"))


def _weight(cost: int, audit: str, width: int) -> int:
    """The scalar weight of a path: cost above, letters from the first of `width` digits on, zeros after them."""
    digits = int(audit.translate(str.maketrans("DIKR", "1234")), 8) if audit else 0
    return (cost << 3 * width) + (digits << 3 * (width - len(audit)))


@lru_cache(maxsize=1 << 16)
def solve(codes: str, start: int) -> tuple[tuple[int, str] | None, ...]:
    """For each end state, (cost, audit) of the least path that uses all rows of `codes` (initial and fault of each).

    Up to two insertions may stand before a row (a third leads to a state that fewer reach); those after the last row are
    left to the next segment or `finish`.
    """
    width = 3 * (len(codes) // 2)

    def edge(path, letter, cost, least, to):
        weight, n = path[0] + (cost << 3 * width) + (DIGIT[letter] << 3 * (width - 1 - path[1])), path[1] + 1
        if least[to] is None or weight < least[to][0]:
            least[to] = (weight, n)

    at = [None] * 4
    at[start] = (0, 0)
    for i in range(0, len(codes), 2):
        initial, fault = codes[i], codes[i + 1]
        # layers of the DAG before the row: no, one or two insertions
        layer, ready = at, list(at)
        for _ in range(2):
            put = [None] * 4
            for s in STATES:
                if layer[s]:
                    edge(layer[s], "I", INSERT, put, PUT[s][1])
            layer = put
            ready = [x if y is None or x is not None and x < y else y for x, y in zip(ready, put)]
        at = [None] * 4
        for s in STATES:
            if ready[s] is None:
                continue
            edge(ready[s], "D", DELETE, at, s)
            if fault in "bd":
                continue
            late = LATE if fault == "t" else 0
            if (to := STEP.get(initial, {}).get(s)) is not None:
                edge(ready[s], "K", late, at, to)
            edge(ready[s], "R", REROLE + late, at, PUT[s][1])
    return tuple(p and _letters(*p[:1], width, p[1]) for p in at)


def least(paths) -> tuple[int, str] | None:
    """The path of the smallest scalar weight, at one common width."""
    paths = [p for p in paths if p]
    width = max((len(p[1]) for p in paths), default=0)
    return min(paths, key=lambda p: _weight(*p, width), default=None)


def join_paths(table: list, other: list) -> list:
    """Paths through two neighbouring segments: table[s][t] then other[t][u]."""
    def both(a, b):
        return a and b and (a[0] + b[0], a[1] + b[1])

    return [[least(both(row[t], other[t][u]) for t in STATES) for u in STATES] for row in table]


def finish(paths) -> tuple[int, str]:
    """The best whole path: insertions complete the last pair."""
    return least([paths[0], paths[3], paths[2] and (paths[2][0] + INSERT, paths[2][1] + "I"), paths[1] and (paths[1][0] + 2 * INSERT, paths[1][1] + "II")])


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


_PART = "conv string, seg long, illegal long, head string, tail string, paths array<array<struct<cost:long,audit:string>>>"


def _unpack(table) -> list:
    return [[p and (p["cost"], p["audit"]) for p in row] for row in table]


def _pack(table) -> list:
    return [[p and {"cost": p[0], "audit": p[1]} for p in row] for row in table]


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none, out = [None] * 4, None
    for batch in batches:
        out = {n: [] for n in ("conv", "seg", "illegal", "head", "tail", "paths")}
        for conv, seg, codes in zip(*(c.to_pylist() for c in batch.columns)):
            initials = codes[::2]
            starts = STATES if seg else (0,)
            for n, v in (("conv", conv), ("seg", seg), ("illegal", illegal_pairs(initials)), ("head", initials[0]), ("tail", initials[-1]),
                         ("paths", _pack([solve(codes, s) if s in starts else none for s in STATES]))):
                out[n].append(v)
        yield _batch(out)


def _batch(out: dict) -> pa.RecordBatch:
    paths = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
    types = {"conv": pa.string(), "seg": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "paths": paths}
    return pa.RecordBatch.from_arrays([pa.array(v, types[n]) for n, v in out.items()], names=list(out))


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {n: [] for n in ("conv", "seg", "illegal", "head", "tail", "paths")}
        for conv, seg, parts in zip(*(c.to_pylist() for c in batch.columns)):
            table, illegal, tail = _unpack(parts[0]["paths"]), parts[0]["illegal"], parts[0]["tail"]
            for part in parts[1:]:
                table = join_paths(table, _unpack(part["paths"]))
                illegal, tail = illegal + part["illegal"] + illegal_pairs(tail + part["head"]), part["tail"]
            for n, v in (("conv", conv), ("seg", seg), ("illegal", illegal), ("head", parts[0]["head"]), ("tail", tail), ("paths", _pack(table))):
                out[n].append(v)
        yield _batch(out)


def _finish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [finish(_unpack([row[0]])[0]) for row in batch.column("paths").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("illegal"), pa.array([c for c, _ in best], pa.int64()),
                                          pa.array([a for _, a in best], pa.string())], names=["conv", "illegal", "cost", "audit"])


def audits(codes: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(conv, illegal, cost, audit) from rows (conv, idx, initial, fault)."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat("initial", "fault").alias("code")))), lambda x: x["code"]), "")
    cut = codes.groupBy("conv", F.floor(F.col("idx") / segment).cast("long").alias("seg")).agg(letters.alias("codes"))  # at most `segment` rows
    parts = materialize(cut.mapInArrow(_solve_batches, _PART), "repair-segments")
    long = parts.filter("seg > 0").select("conv").distinct()
    done, open_ = parts.join(long, "conv", "left_anti"), materialize(parts.join(long, "conv", "left_semi"), "repair-long")
    while (open_.agg(F.max("seg")).first()[0] or 0) > 0:
        group = F.array_sort(F.collect_list(F.struct("seg", "illegal", "head", "tail", "paths")))  # at most `fan`
        up = open_.withColumn("up", F.floor(F.col("seg") / fan).cast("long")).groupBy("conv", "up").agg(group.alias("parts"))
        open_ = materialize(up.mapInArrow(_join_batches, _PART), "repair-joined")
    return materialize(done.unionByName(open_).select("conv", "illegal", "paths").mapInArrow(_finish_batches, "conv string, illegal long, cost long, audit string"), "repair-audits")


# the repaired text -----------------------------------------------------------------------------------

def repaired(initial: str, letter: str, state: int) -> tuple[str, int]:
    """(role put, or '' for the row's own; state after) of an edit that leaves a row."""
    if letter == "K":
        return "", STEP[initial][state]
    put, to = PUT[state]
    return NAME[put], to


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation follow its audit (seq -1); lines go into the running hash, one batch is held."""
    out, sha, conv, audit, at, state, lines = {}, None, None, "", 0, 0, 0

    def line(role, text):
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = repaired("", "I", state)
            line(role, "")
            at += 1

    def close():
        if sha is not None:
            inserted()
            out.setdefault("conv", []).append(conv)
            out.setdefault("repaired_sha256", []).append(sha.hexdigest())

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out.pop(n, []), pa.string()) for n in ("conv", "repaired_sha256")], names=["conv", "repaired_sha256"])
        return batch

    for batch in batches:
        for c, seq, role, initial, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "seq", "role", "initial", "text"))):
            if seq < 0:
                close()
                sha, conv, audit, at, state, lines = hashlib.sha256(), c, text, 0, 0, 0
                continue
            inserted()
            letter = audit[at]
            at += 1
            if letter != "D":
                put, state = repaired(initial, letter, state)
                line(put or role, text)
        yield flush()
    close()
    yield flush()


def hashes(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv, repaired_sha256).  SHA-256 is sequential, so a conversation's lines pass one task, in order, unheld."""
    lead = audit.select("conv", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("x").alias("initial"), F.col("audit").alias("text"))
    both = lead.unionByName(rows.select("conv", "seq", "role", "initial", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(_hash_batches, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of `conversations`: faults found in `rows` (default: themselves), and the cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    rows = typed(conversations).fillna(BLANK, ["role", "text"]) if rows is None else rows
    ordered, codes = coded(rows)
    found = audits(codes, segment, fan)
    sums = [F.sum(F.when(F.col("fault") == f, 1).otherwise(0)) for f in "bdt"]
    by_turn = codes.groupBy("conv", "turn").agg(*[s.alias(n) for s, n in zip(sums, ("blank", "duplicate", "truncated"))])
    turn = F.col("turn").cast("decimal(20,0)")
    stats = by_turn.groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).try_cast("long").alias("gaps"),
                                        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    ids = typed(conversations).select(key().alias("conv")).distinct()
    table = ids.join(stats, "conv", "left").join(found, "conv", "left").join(hashes(ordered, found), "conv", "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return table.select(F.col("conv").try_cast("long").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged_repair(conversations: DataFrame) -> DataFrame:
    """The registered query: the repair of every conversation after the seeded damage."""
    return repair(conversations, damage(conversations))
