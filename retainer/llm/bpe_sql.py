"""Byte-level BPE as recursive DuckDB queries inside each partition (operator 1).

Per partition: texts are cut by the tokenizer's pattern (vectorised over character
classes), each distinct piece that is no vocabulary entry becomes token-position rows, and
a recursive query joins neighbouring tokens with the merge table and contracts the leftmost
pair of minimum rank of every piece, until no piece has a pair left.  Decoding joins ids
with the vocabulary and concatenates in position order.  Nothing is shuffled; a worker
keeps the ids of lately seen pieces, so a piece is encoded about once per worker.

A long piece (blobs, rulers, runs of blanks) is first cut where no vocabulary entry can cross; what stays long is
contracted at all places of its minimum rank in a step, by calls of bounded steps, so state stays small and a
step costs time in proportion to the piece.

Nulls: a null text is empty (no ids, hash of no bytes); a null doc_id is carried; repeated
rows are encoded as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer.llm.textops import TokenStore, chunks, string_array
from retainer.llm.workspace import only

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: key = piece * 2^32 + position.  `am` is the key at which a piece's leftmost minimum-rank pair starts.
_ENCODE = """
WITH RECURSIVE state(key, w, tok, k, step) AS (
  SELECT key, w, tok, m.k, 0
  FROM (SELECT key, w, tok, lead(tok) OVER o AS nt, lead(w) OVER o AS nw FROM bytes_in WINDOW o AS (ORDER BY key)) t
  LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 1048576 + t.nt AND t.nw = t.w
  UNION ALL
  SELECT key, w, tok, m.k, step + 1
  FROM (
    SELECT key, w, step, CASE WHEN key = am THEN bk ELSE tok END AS tok,
           CASE WHEN key = am THEN CASE WHEN nnw = w THEN nnt END
                WHEN nkey = am THEN bk
                WHEN nw = w THEN nt END AS nx
    FROM (
      SELECT s.key, s.w, s.tok, s.step, b.am, b.bk, lag(s.key) OVER o AS pkey, lead(s.key) OVER o AS nkey,
             lead(s.tok) OVER o AS nt, lead(s.w) OVER o AS nw, lead(s.tok, 2) OVER o AS nnt, lead(s.w, 2) OVER o AS nnw
      FROM state s
      JOIN (SELECT w, min(k) AS bk, arg_min(key, k::BIGINT * 4294967296 + (key & 4294967295)) AS am
            FROM state WHERE k IS NOT NULL GROUP BY w) b ON s.w = b.w
      WINDOW o AS (ORDER BY s.key))
    WHERE pkey IS DISTINCT FROM am) t
  LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 1048576 + t.nx
), final AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT s.w, s.tok FROM state s JOIN final f ON s.w = f.w AND s.step = f.step ORDER BY s.key
"""

#: For long pieces: a step contracts a piece's minimum-rank pairs from the left, every other one of a run of overlapping
#: pairs, up to the first whose new token forms a pair of lower rank.  Steps are bounded; `k` says what is left to do.
_ENCODE_LONG = """
WITH RECURSIVE state(key, w, tok, k, step) AS (
  SELECT key, w, tok, m.k, 0
  FROM (SELECT key, w, tok, lead(tok) OVER o AS nt, lead(w) OVER o AS nw FROM long_in WINDOW o AS (ORDER BY key)) t
  LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 1048576 + t.nt AND t.nw = t.w
  UNION ALL
  SELECT key, w, tok, m.k, step + 1
  FROM (
    SELECT key, w, tok, step, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nx
    FROM (
      SELECT key, w, step, CASE WHEN taken THEN bk ELSE tok END AS tok, lag(taken, 1, false) OVER (ORDER BY key) AS gone
      FROM (
        SELECT t.*, t.first AND t.key <= min(CASE WHEN a.k < t.bk OR z.k < t.bk THEN t.key ELSE 9223372036854775807 END) OVER (PARTITION BY t.w) AS taken
        FROM (
          SELECT *, r % 2 = 1 AS first,
                 CASE WHEN r % 2 = 1 THEN CASE WHEN r > 1 THEN bk WHEN pw = w THEN pt END::BIGINT * 1048576 + bk END AS left_pair,
                 CASE WHEN r % 2 = 1 AND nnw = w THEN bk::BIGINT * 1048576 + nnt END AS right_pair
          FROM (
            SELECT *, CASE WHEN same THEN i - coalesce(max(CASE WHEN NOT same THEN i END) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS r
            FROM (
              SELECT s.*, b.bk, coalesce(s.k = b.bk, false) AS same, row_number() OVER o AS i, lag(s.tok) OVER o AS pt, lag(s.w) OVER o AS pw,
                     lead(s.tok, 2) OVER o AS nnt, lead(s.w, 2) OVER o AS nnw
              FROM state s JOIN (SELECT w, min(k) AS bk FROM state WHERE k IS NOT NULL GROUP BY w) b ON s.w = b.w
              WHERE s.step < $steps
              WINDOW o AS (ORDER BY s.key)))) t
        LEFT JOIN merges a ON a.pair = t.left_pair LEFT JOIN merges z ON z.pair = t.right_pair))
    WHERE NOT gone
    WINDOW o AS (ORDER BY key)) t
  LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 1048576 + t.nx
), final AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT s.key, s.w, s.tok, max(s.k IS NOT NULL) OVER (PARTITION BY s.w) AS open FROM state s JOIN final f ON s.w = f.w AND s.step = f.step ORDER BY s.key
"""

#: Pieces above LONG bytes are cut where no merge can cross, and parts still above it take `_ENCODE_LONG`, LONG_BATCH bytes
#: (or one part) and LONG_ROWS rows of state a call.
LONG, LONG_BATCH, LONG_ROWS = 256, 1 << 20, 4 << 20

_DECODE = """
SELECT i.doc, string_agg(v.piece, '' ORDER BY i.pos) AS piece
FROM ids_in i JOIN vocabulary v ON v.id = i.id GROUP BY i.doc
"""


@lru_cache(1)
def char_classes() -> np.ndarray:
    r"""Class of every code point: \p{L}, \p{N}, white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.findall(pattern, every):
            table[list(map(ord, run))] = kind
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    cp = first.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    for low, high, mask, tail in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((first >= low) & (first < high))
        if len(at):
            value = first[at] & mask
            for j in range(1, tail + 1):
                value = (value << 6) | (padded[lead[at] + j] & 0x3F)
            cp[at] = value
    return lead, np.minimum(cp, 0x10FFFF)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the matches of the pattern start; no match crosses a row.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, numbers or other characters
    with one blank before, white space up to the last character before a non-space, white space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead, cp = code_points(data)
    n = len(cp)
    kind = char_classes()[cp]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, offsets)] = True
    change = head.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change[n] = True
    run = change[:n]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 0x20) & ~head[1:n]
    space = kind == SPACE
    start = run & (space | ~blank_before)
    start |= space & change[1:] & ~head[1:]  # the last of a white-space run before other text
    quote = np.flatnonzero((cp == 0x27) & run & ~blank_before & change[1:] & ~head[1:])
    quote = quote[quote + 1 < n]
    one = cp[quote + 1]
    has_two = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)]
    two = np.where(has_two, cp[np.minimum(quote + 2, n - 1)], 0)
    single = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
    double = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
    width = np.where(single, 1, np.where(double, 2, 0))
    start[quote[width > 0] + 1] = False
    after = (quote + 1 + width)[width > 0]
    start[after[after < n]] = True
    return lead[start]


class Bpe:
    """DuckDB tables of one vocabulary, and the queries over them."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(left * 1048576 + right, k) for piece, k in self.ranks.items() for cut in range(1, len(piece))
                 if (left := self.ranks.get(piece[:cut])) is not None and (right := self.ranks.get(piece[cut:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": tempfile.gettempdir()})
        self._table("merges", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "k": pa.array([k for _, k in pairs], pa.int32())}))
        # bytes travel as the characters U+0000 to U+00FF, as an aggregate of strings exists
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()),
                                            "piece": [p.decode("latin-1") for p in self.ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries of two bytes, and three bytes in a row of any entry, as sorted numbers."""
        two = [256 * p[0] + p[1] for p in self.ranks if len(p) == 2]
        three = {p[i : i + 3] for p in self.ranks for i in range(len(p) - 2)}
        return np.unique(two), np.unique([int.from_bytes(t, "big") for t in three])

    def cut(self, piece: bytes) -> list[bytes]:
        """Parts of a piece that its encoding never joins.

        A token over the border of x and y is the entry xy, or holds wxy or xyz; where no entry does, no merge crosses.
        """
        d = np.frombuffer(piece, np.uint8).astype(np.int64)
        two, three = self.grams
        joined = np.isin(d[:-1] * 256 + d[1:], two)
        held = np.isin(d[:-2] * 65536 + d[1:-1] * 256 + d[2:], three)
        joined[:-1] |= held
        joined[1:] |= held
        at = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of long parts, in calls of bounded steps that go on from the last state."""
        size = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        key = (w.astype(np.int64) << 32) + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        rows = pa.table({"key": key, "w": w, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]})
        out: list = [None] * len(words)
        while len(rows):
            self.db.register("long_in", rows)
            got = self.db.sql(_ENCODE_LONG, params={"steps": max(8, LONG_ROWS // len(rows))}).to_arrow_table()
            self.db.unregister("long_in")
            done = got.filter(pc.invert(got["open"]))
            tokens, of = done["tok"].to_numpy(), done["w"].to_numpy()
            for j in np.unique(of):
                out[j] = tokens[np.searchsorted(of, j) : np.searchsorted(of, j, "right")]
            rows = got.filter(got["open"]).select(["key", "w", "tok"])
        return out

    def _encode_long(self, pieces: list[bytes], batch: int) -> list[np.ndarray]:
        """Ids of long pieces, by way of their parts; each distinct part is encoded once."""
        parts = [self.cut(p) for p in pieces]
        distinct = list(dict.fromkeys(x for p in parts for x in p))
        short = [x for x in distinct if len(x) <= LONG]
        ids = dict(zip(short, self.encode(short, batch), strict=True))
        group: list[bytes] = []
        held = 0
        for x in [x for x in distinct if len(x) > LONG] + [b""]:
            if group and (not x or held + len(x) > LONG_BATCH):
                ids |= zip(group, self._contract(group), strict=True)
                group, held = [], 0
            group.append(x)
            held += len(x)
        return [np.concatenate([ids[x] for x in p]) for p in parts]

    def encode(self, pieces: list[bytes], batch: int = 40_000) -> list:
        """Ids of each piece; a piece that is a vocabulary entry is that entry."""
        out: list = [None] * len(pieces)
        unknown, long = [], []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None and piece:
                (unknown if len(piece) <= LONG else long).append(i)
            else:
                out[i] = [] if rank is None else [rank]
        if long:
            for i, ids in zip(long, self._encode_long([pieces[i] for i in long], batch), strict=True):
                out[i] = ids
        for a in range(0, len(unknown), batch):
            part = unknown[a : a + batch]
            words = [pieces[i] for i in part]
            size = np.array([len(w) for w in words])
            w = np.repeat(np.arange(len(words), dtype=np.int32), size)
            position = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("bytes_in", pa.table({"key": (w.astype(np.int64) << 32) + position, "w": w,
                                                   "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
            got = self.db.sql(_ENCODE).to_arrow_table()
            self.db.unregister("bytes_in")
            tokens = got["tok"].to_numpy()
            bound = np.searchsorted(got["w"].to_numpy(), np.arange(len(words) + 1))
            for j, i in enumerate(part):
                out[i] = tokens[bound[j] : bound[j + 1]]
        return out

    def decode(self, ids: np.ndarray, size: np.ndarray) -> dict[int, bytes]:
        """Bytes of each document with ids, by its number; `size` has the number of ids of each."""
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.db.register("ids_in", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids_in")
        return dict(zip(got["doc"].to_pylist(), (x.encode("latin-1") for x in got["piece"].to_pylist()), strict=True))


_LOADED: dict[str, tuple[Bpe, TokenStore]] = {}


def _loaded(path: str) -> tuple[Bpe, TokenStore]:
    if path not in _LOADED:
        bpe = Bpe(path)
        _LOADED[path] = bpe, TokenStore(bpe.encode)
    return _LOADED[path]


def _round_trip(path: str, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, store = _loaded(path)
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64())
            for first, data, offsets in chunks(batch.column(1), 2 << 20):
                starts = piece_starts(data, offsets)
                ids, size = store.gather(string_array(data, np.append(starts, len(data)))) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                stop = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
                decoded = bpe.decode(ids, np.diff(stop))
                raw = ids.astype("<u4").tobytes()
                cols = [doc_ids.slice(first, len(offsets) - 1), pa.array(np.diff(stop)),
                        [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(stop[:-1], stop[1:], strict=True)],
                        [hashlib.sha256(decoded.get(i, b"")).hexdigest() for i in range(len(offsets) - 1)]]
                if with_ids:
                    cols += [[ids[a:b].tolist() for a, b in zip(stop[:-1], stop[1:], strict=True)], [decoded.get(i, b"") for i in range(len(offsets) - 1)]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def bpe_round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids are those of a tiktoken encoder with this rank file and the usual pattern, without
    special tokens; `with_ids` adds ids (array) and decoded (binary).
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(_round_trip(path, with_ids), schema)
