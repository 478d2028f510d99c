"""Conversation repair, the conversation trie and paragraph sketches against brute force and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
#: Nulls in every column, blank, empty and long texts, tied turns, repeated rows, odd roles, negative ids, gaps in turns.
ROWS = [
    (0, 0, "system", "Be kind."), (0, 1, "user", "Hi?"), (0, 2, "assistant", "Yes"), (0, 2, "assistant", "Also."), (0, 9, "user", "Bye!"),
    (1, 0, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, None, "tool", "x."), (1, 3, None, "said."), (1, 4, "assistant", None),
    (2, None, None, None), (2, None, "user", ""), (3, 5, "", " \t\n"), (3, 6, "assistant", "long. " * 5000), (3, 7, "user", "naïve ☕ 漢字."),
    (-3, 0, "user", "negative."), (-3, 1, "assistant", "ids!"), (None, 0, "user", "nobody."), (None, 0, "user", "nobody."), (None, 1, "assistant", "there"),
    (5, 0, "system", "Be kind."), (6, 0, "user", "Hi?"), (6, 0, "user", "Hi?"), (7, 0, "user", "Hi?"), (7, 1, "assistant", "Yes."),
]


@pytest.fixture(scope="module")
def edge(spark):
    clash = {c: F.lit("x") for c in ("node", "depth", "seq", "audit", "size", "idx", "pair", "digest")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


def long_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool"]
    return [(1 + (i % 7 == 0), i, rng.choice(roles[: 2 + (i % 3 == 0) * 2]), rng.choice(["Well.", "Yes!", "cut", "", "So?"]) * (i % 5 > 0) + str(i % 40) + rng.choice(["", "."]))
            for i in range(700)]


# operator 11 -----------------------------------------------------------------------------------------

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repair_plainly(rows):
    """Least (cost, audit) by uniform-cost search over (row, state), letter by letter."""
    convs = {}
    for c, t, role, text in rows:
        kept = convs.setdefault(c, [])
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot:
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            kept += [(t, "user" if lot == 4 else role, text)] * (1 + (lot == 3))
    out = {}
    for c, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials, turns = [r[:1] for _, r, _ in kept], [t for t, _, _ in kept if t is not None]
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if state == "end":
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(kept) and state in (0, 3):
                heapq.heappush(heap, (cost, audit, i, "end", lines))
                if not heap[0][3] == "end" and (cost, audit) < heap[0][:2]:
                    break
            for role in ("user", "assistant"):
                if role[0] in STEP[state]:
                    heapq.heappush(heap, (cost + 2, audit + "I", i, STEP[state][role[0]], lines + ((role, ""),)))
            if i < len(kept):
                _, role, text = kept[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
                if faults[i] not in ("b", "d"):
                    late = faults[i] == "t"
                    if role[:1] in STEP[state]:
                        heapq.heappush(heap, (cost + late, audit + "K", i + 1, STEP[state][role[:1]], lines + ((role, text),)))
                    for put in ("user", "assistant"):
                        if put[0] in STEP[state]:
                            heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, STEP[state][put[0]], lines + ((put, text),)))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def repaired(df, **sizes):
    from retainer.llm import repair

    got = repair.repair(df, repair.damage(df), **sizes).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repair_equals_plain_search(given, edge):
    for df in (given, edge):
        assert repaired(df) == repair_plainly(rows_of(df))


def test_repair_of_long_conversations_in_segments(spark):
    df = spark.createDataFrame(long_rows(), SCHEMA).repartition(5)
    want = repair_plainly(long_rows())
    assert repaired(df, segment=3, fan=2) == want
    assert repaired(df) == want


def test_repair_of_nothing(edge):
    assert repaired(edge.limit(0)) == {}


def test_conversation_without_rows_after_damage(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(4, turn, "user", "gone.")], SCHEMA)) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_weights_decide_cost_then_audit():
    from retainer.llm.repair import finish, least, solve

    assert least([(2, "KI"), (2, "IK"), (3, "D"), None]) == (2, "IK")
    assert least([(2, "D"), (2, "DI")]) == (2, "D")  # zero end padding
    assert finish(solve("", 0)) == (0, "")
    assert finish(solve("s ", 0)) == (3, "D")
    assert finish(solve("a ", 0)) == (2, "IK")


def test_places_of_a_conversation_over_many_partitions(spark):
    from retainer.llm.conversations import numbered

    rng, at, rows = random.Random(2), {}, []
    for part in range(9):
        for i in range(rng.randint(1, 4)):
            rows.append(part)
    convs = sorted(rng.choice("abc") if i % 5 else "b" for i in range(len(rows)))
    data, place = [], 0
    for n, (part, conv) in enumerate(zip(rows, convs)):
        data.append((conv, (part << 33) + n, at.get(conv, 0)))
        at[conv] = at.get(conv, 0) + 1
    got = numbered(spark.createDataFrame(data, "conv string, seq long, want long")).collect()
    assert len(got) == len(data) and all(r["idx"] == r["want"] for r in got)


# operator 12 -----------------------------------------------------------------------------------------

def by_sql(df, name, sql):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=repr)


@pytest.mark.parametrize("limit", [20_000, 4])
def test_trie_equals_sql(given, edge, limit):
    from retainer.llm.trie import ORACLE_SQL, prefix_trie

    for df in (given, edge):
        got = sorted((tuple(r) for r in prefix_trie(df, limit).collect()), key=repr)
        assert got == by_sql(df, "conversations", ORACLE_SQL)
        assert sum(r[1] == 0 for r in got) == 1


def test_trie_of_long_and_shared_conversations(spark):
    from retainer.llm.trie import ORACLE_SQL, prefix_trie

    rows = [(c, t, "user", "same" if t < 30 + c % 3 else f"{c}-{t}") for c in range(0, 40, 5) for t in range(60 + 50 * (c == 10))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in prefix_trie(df, 16).collect()), key=repr)
    assert got == by_sql(df, "conversations", ORACLE_SQL)


def test_trie_of_nothing(edge):
    from retainer.llm.trie import prefix_trie

    assert prefix_trie(edge.limit(0)).collect() == []
    assert prefix_trie(edge.filter("conv_id is null")).collect() == []


def test_running_totals_over_blocks(spark):
    from retainer.llm import trie

    rows = [(c, d, (d * 7 + c) % 11) for c in (1, 2) for d in range(1, 3000 - 1500 * c)]
    df = spark.createDataFrame(rows, "c long, d long, v long")
    got = {(r["c"], r["d"]): r["v"] for r in trie.running(df, ["c"], "d", ["v"], F.sum, lambda x, y: x + y, backward=True).collect()}
    want = {}
    for c, d, v in sorted(rows, reverse=True):
        want[c, d] = want.get((c, d + 1), 0) + v
    assert got == want


def test_decomposition_equals_plain_rollup():
    from retainer.llm.trie import decompose

    rng = random.Random(9)
    for n in (1, 2, 3, 50, 400):
        for reach in (1, 3, n):
            parent = [-1] + [rng.randrange(max(0, i - reach), i) for i in range(1, n)]
            own = [rng.randrange(100) for _ in range(n)]
            want = list(own)
            for i in range(n - 1, 0, -1):
                want[parent[i]] += want[i]
            assert decompose(parent, [0] * n, [own], [[0] * n]) == [want]


# operator 13 -----------------------------------------------------------------------------------------

LONG = "One long line without an end " * 60 + "\nshort\n" + "Many sentences. " * 200
DOCS = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, "\n\n"), (6, "a\nb\nc\nd"), (6, "a\nb\nc\nd"), (6, "other"), (None, "nobody"), (None, "nobody"), (None, None),
        (7, "naïve ☕ 漢字\n" * 3), (8, "\n".join(f"line {i}" for i in range(3000))), (9, "\n".join(f"line {i}" for i in range(1, 3001))), (-5, "x" * 5000)]


def test_sketches_equal_sql(spark):
    from retainer.llm.iblt import ORACLE_SQL, fingerprint_versions

    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pair", "own", "mark", "id", "cell")})
    for df in (given, odd, odd.limit(1)):
        got = sorted((tuple(r) for r in fingerprint_versions(df).collect()), key=repr)
        want = by_sql(df.select("doc_id", "text"), "documents", ORACLE_SQL)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert all(abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x[5:], y[5:]))
    assert fingerprint_versions(odd.limit(0)).collect() == []


def test_sketches_of_equal_texts_and_close_versions(spark):
    from retainer.llm.iblt import fingerprint_versions

    got = {r["doc_id"]: r for r in fingerprint_versions(spark.createDataFrame(DOCS, "doc_id long, text string").filter("doc_id in (1, 2, 8, 9)")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[8]["fingerprint"]
    assert got[2]["near_next"] == 1.0 and got[9]["near_next"] == pytest.approx(2999 / 3001)


def test_peeling_recovers_differences_and_retries(spark):
    from retainer.llm import iblt

    small, large = list(range(100)), list(range(1000, 1400))
    pairs = spark.createDataFrame([(1, 0, small, small[3:]), (2, 0, small, large), (3, 0, small, small), (4, 0, [], [7])], "pair long, kind int, one array<long>, other array<long>").withColumn("width", F.lit(4).cast("long"))
    got = {r["pair"]: (r["plus"], r["minus"]) for r in iblt.differences(pairs).collect()}
    assert got == {1: (3, 0), 2: (100, 400), 4: (0, 1)}
    rows = spark.createDataFrame([(1, 4, d, 1) for d in large], "pair long, width long, digest long, sign long")
    one = iblt.peel(iblt.sketch(rows, ["pair", "width"]), ["pair", "width"]).first()
    assert one["left"] > 0  # too small a sketch says so


def test_sketches_run_no_python(spark):
    from retainer.llm.iblt import fingerprint_versions

    df = fingerprint_versions(spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


# operator 8: words encoded together ------------------------------------------------------------------

def test_words_encoded_together_equal_the_tokenizer():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from retainer.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["½ ¾ x½y ½ ²", "a½ b " * 300, "é ́x  y z", "<|endoftext|> a<|endoftext|>b", "", None, "I'll  don't 12,345", "　漢字 ﬁ", " ".join(f"w{i}½"[: 2 + i % 4] for i in range(900))]
    for column in (texts, texts[:1], []):
        got = [ids.tolist() for _, ids in packing.document_tokens(pa.array(column, pa.string()), packing.FlatStore(packing.word_tokenizer(path)), 1)]
        assert got == [plain.encode(x or "", add_special_tokens=False).ids + [1] for x in column]


def test_words_are_parted_where_the_tokenizer_parts_them():
    """Ids of texts with capitals, marks, quotes and special tokens equal the tokenizer's; words share their stored ids."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from retainer.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for text in ["J̌. J̌X Ǩ!! İ. İx. X!", "Don't DOGS'. 'S 's. WE'LL! a.b.c. ... !? 9. a…. ΣΣ. K, Z̸= ≮", "Ab.<|endoftext|>. X<|EndOfText|>!", "Q¾R. ¾! A¾.", "", None]:
        [(_, ids)] = packing.document_tokens(pa.array([text], pa.string()), packing.FlatStore(packing.word_tokenizer(path)), 1)
        assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    store = packing.FlatStore(packing.word_tokenizer(path))
    list(packing.document_tokens(pa.array(["Word word. WORD, word"]), store, 1))
    assert set(store.place) == {b"word", b".", b","}
