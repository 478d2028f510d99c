"""The training-data operators against brute force, on the smallest tables and on edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Nulls in every column, empty and blank texts, repeated rows, ties and a long text.
EDGE = [
    (1, "the cat sat on the mat and looked at the dog over there " * 3, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n", "de", None),
    (5, "the cat sat on the mat and looked at the dog over there " * 3, "en", "a"), (5, "the cat sat on the mat and looked at the dog over there " * 3, "en", "a"),
    (6, "Wort", "de", "b"), (7, "der Hund und die Katze sind im Haus " * 400, "de", "b"), (None, "the cat sat", "en", "a"),
    (None, None, None, None), (8, "12 34 !!", "en", "a"), (9, "naïve café ☕ 漢字", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    # extra columns with the operators' own names
    return rows.withColumns({c: F.lit("x") for c in ("score", "kept", "n", "part", "g", "row")})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def texts(docs):
    return {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# operator 1 ---------------------------------------------------------------------------------------

def tiktoken_encoder():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(docs, edge, empty):
    from retainer.llm.bpe_sql import bpe_round_trip

    encoder = tiktoken_encoder()
    for table in (docs, edge):
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_round_trip(table).collect())
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = encoder.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe_round_trip(empty).count() == 0


def test_bpe_of_long_pieces(spark):
    import random

    from retainer.llm.bpe_sql import bpe_round_trip

    encoder, rng = tiktoken_encoder(), random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "0123456789", "=", " ", "\n", "-=_*#", "あいうえおかきくけこ"]
    texts = ["".join(rng.choices(a, k=100_000 // len(a[0].encode()))) for a in alphabets]
    texts.append("x " + "".join(rng.choices(["the", "and", "tion", "inter", "er"], k=30_000)) + "  end")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_round_trip(rows).collect()}
    for i, text in enumerate(texts):
        ids = np.array(encoder.encode_ordinary(text), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_contracts_many_places_a_step_like_one(monkeypatch):
    import random

    import public_tokenizers

    from retainer.llm import bpe_sql

    bpe, encoder, rng = bpe_sql.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), tiktoken_encoder(), random.Random(2)
    vocabulary = list(bpe.ranks)
    words = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 3, 5, 26])], k=rng.randrange(2, 80))) for _ in range(1500)]
    words += [b"".join(rng.choices(vocabulary, k=rng.randrange(2, 12))) for _ in range(1500)]
    words = [w for w in dict.fromkeys(words) if w not in bpe.ranks]
    want = [encoder._encode_single_piece(w) for w in words]
    for rows in (bpe_sql.LONG_ROWS, 1):  # one call; calls of eight steps
        monkeypatch.setattr(bpe_sql, "LONG_ROWS", rows)
        assert [g.tolist() for g in bpe._contract(words)] == want
    assert [g.tolist() for g in bpe._encode_long(words, 40_000)] == want


def test_piece_starts_follow_the_pattern():
    import public_tokenizers
    import pyarrow as pa
    import regex

    from retainer.llm.bpe_sql import piece_starts
    from retainer.llm.textops import chunks

    rng = np.random.default_rng(3)
    bits = ["a", "é", "'", "s", "re", "'ll", " ", "  ", "\n", "\t", "1", "²", "!", "　", "\x1c", "漢", "😀", "́"]
    lines = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    for _, data, offsets in chunks(pa.array(lines)):
        starts = piece_starts(data, offsets)
        cuts = np.append(starts, len(data))
        pieces = [bytes(data[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:])]
    assert pieces == [p for x in lines for p in regex.findall(public_tokenizers.PATTERN, x)]


# operator 2 ---------------------------------------------------------------------------------------

def test_language_held_out_accuracy(docs, edge, empty):
    from retainer.llm.crf_langid import language_id

    got = language_id(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.true).mean() >= 0.95
    rows = language_id(edge).toPandas()
    assert len(rows) == len(EDGE) and rows.score.between(0, 1).all()
    assert set(rows[rows.doc_id.isin([2, 3, 4, 8])].lang_pred) == {"und"}
    assert language_id(empty).count() == 0


def test_rare_languages_are_learned(spark):
    from retainer.llm.crf_langid import fit

    rows = [(i, "the cat sat on the mat", "en") for i in range(400)] + [(i, "кошка сидит на окне", "ru") for i in (1001, 1002)] + [(2000, "η γάτα " * 9000, "el")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=20)
    assert model.labels == ["el", "en", "ru"]


def test_forward_backward_equals_a_plain_chain():
    from retainer.llm.crf_langid import forward_backward

    rng = np.random.default_rng(0)
    score, first = rng.normal(size=(300, 3)), np.zeros(300, bool)
    first[[0, 7, 150]] = True
    move, start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    got, pairs = forward_backward(score, first, start, move, pairs=True)
    want, seen = [], np.zeros((3, 3))
    for a, b in ((0, 7), (7, 150), (150, 300)):
        e = np.exp(score[a:b])
        alpha, beta = [start * e[0]], [np.ones(3)]
        for i in range(1, b - a):
            v = alpha[-1] @ move * e[i]
            alpha.append(v / v.sum())
        for i in range(b - a - 1, 0, -1):
            v = move @ (e[i] * beta[0])
            beta.insert(0, v / v.sum())
        z = np.array(alpha) * np.array(beta)
        want.append(z / z.sum(axis=1, keepdims=True))
        for i in range(1, b - a):
            y = np.outer(alpha[i - 1], e[i] * beta[i]) * move
            seen += y / y.sum()
    assert np.allclose(got, np.vstack(want)) and np.allclose(pairs, seen)


def test_code_switched_text_is_labelled_by_word():
    from retainer.llm.crf_langid import Crf, emissions, forward_backward, words_of

    rng = np.random.default_rng(1)
    vocab = {"aa": ["the", "house", "with", "thing", "whole"], "bb": ["und", "haus", "mit", "ding", "ganz"]}
    lines = [(" ".join(rng.choice(vocab[k], 40)), k) for k in vocab for _ in range(30)]
    model = Crf(["aa", "bb"]).fit([x for x, _ in lines], [k for _, k in lines])
    mixed = np.frombuffer(" ".join(list(rng.choice(vocab["aa"], 30)) + list(rng.choice(vocab["bb"], 20))).encode(), np.uint8)
    words = words_of(mixed, np.array([0, len(mixed)]))
    label = forward_backward(emissions(words, model.weight), words.first, model.start, model.move)[0].argmax(axis=1)
    assert (label == np.repeat([0, 1], [30, 20])).mean() > 0.95


# operator 3 ---------------------------------------------------------------------------------------

def test_fixity_equals_sql_and_handles_edges(spark, duck):
    from retainer.llm import fixity

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    columns = ["file_no", "record_no", "page_id", "record_offset", "record_length", "sha256", "replica_offset", "replica_sha256", "damage"]
    none = lambda row: tuple(None if x != x else x for x in row)
    want = sorted(map(none, duck.sql(fixity.ORACLE_SQL).df()[columns].astype(object).where(lambda x: x.notna(), None).values))
    got = sorted(tuple(r[c] for c in columns) for r in fixity.seeded_audit(pages).collect())
    assert got == want and got
    rows = [(None, None, None), (1, None, ""), (1, "u", "x" * 100000), (1, "u", "x" * 100000), (2, "é", None)] + [(i, "u", "text") for i in range(3, 400)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit(1))
    kept, copy = ({(r["file_no"], r["node"]): (r["hash"], r["record_offset"], r["record_length"]) for r in x.collect()} for x in fixity.replicas(table, per_file=64))
    bad = {place for place, record in kept.items() if copy.get(place) != record}
    assert len(kept) == len(rows) and {(r["file_no"], r["record_no"]) for r in fixity.seeded_audit(table, per_file=64, fanout=4).collect()} == bad and bad
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("text").alias("html"))
    kinds = {r["damage"]: r["n"] for r in fixity.seeded_audit(many).groupBy("damage").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"missing", "changed", "moved"} and sum(kinds.values()) < 150
    assert fixity.seeded_audit(table.limit(0)).count() == 0


def test_fixity_of_two_record_tables(spark):
    from retainer.llm import fixity

    schema = "file_no long, node long, page_id long, record_offset long, record_length long, hash string"
    kept = [(f, n, 100 * f + n, 50 * n, 50, f"{f}-{n}") for f in range(3) for n in range(20)]
    copy = {r[:2]: r for r in kept}
    copy[0, 3] = (0, 3, 3, 151, 50, "0-3")  # the right bytes at a wrong offset
    copy[0, 7] = (0, 7, 7, 350, 50, "other")
    copy[1, 19] = (1, 19, 119, 950, 51, "1-19")
    del copy[2, 0]
    copy[2, 20] = (2, 20, 220, 1000, 50, "new")  # a record, and a file, that only the copy has
    copy[9, 0] = (9, 0, None, 0, 50, "new file")
    one, two = spark.createDataFrame(kept, schema), spark.createDataFrame(list(copy.values()), schema).withColumn("extra", F.lit(1))
    found = lambda a, b: {(r["file_no"], r["record_no"], r["damage"], r["page_id"], r["replica_offset"]) for r in fixity.fixity_audit(a, b, per_file=32, fanout=4).collect()}
    assert found(one, two) == {(0, 3, "moved", 3, 151), (0, 7, "changed", 7, 350), (1, 19, "changed", 119, 950), (2, 0, "missing", 200, None),
                               (2, 20, "extra", 220, 1000), (9, 0, "extra", None, 0)}
    assert found(one, one) == set()
    assert {r[2] for r in found(one, two.limit(0))} == {"missing"} and len(found(one.limit(0), one)) == 60
    # nodes cover ranges of offsets, so a file whose records all lie one byte further has another root
    late = one.withColumn("record_offset", F.col("record_offset") + 1)
    roots = [{r["file_no"]: (r["hash"], r["first"], r["last"]) for r in fixity.tree(fixity.leaves(x), 32, 4)[-1].collect()} for x in (one, late)]
    assert roots[0][0][1:] == (0, 1000) and roots[1][0][1:] == (1, 1001) and all(roots[0][f][0] != roots[1][f][0] for f in range(3))


# operator 4 ---------------------------------------------------------------------------------------

def repeats(rows, length):
    first, out = {}, []
    for i, b in sorted(rows, key=lambda x: x[0]):
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 1 << 15, "hot_runs": 2}])
def test_repeats_equal_brute_force(docs, edge, empty, options):
    from retainer.llm.suffix_dedup import remove_repeats

    for table in (docs, edge):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
        got = [tuple(r) for r in remove_repeats(table, **options).collect()]
        assert sorted(r for r in got if r[0] is not None) == repeats([r for r in rows if r[0] is not None], 50)
        assert sorted(r[1:4] for r in got if r[0] is None) == sorted((len(b), 0, 0) for i, b in rows if i is None)
    assert remove_repeats(empty, **options).count() == 0


def test_suffix_order_is_that_of_the_suffixes():
    from retainer.llm.suffix_dedup import suffix_order

    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 3), (2, 3), (5, 2), (100, 2), (1000, 3), (997, 200), (2001, 1)):
        s = rng.integers(1, k + 1, n)
        raw = bytes(s.astype(np.uint8))
        assert suffix_order(s, 12).tolist() == sorted(range(n), key=lambda i: raw[i:])
    for seed in range(40):  # to a depth only: long repeats tie
        rng = np.random.default_rng(seed)
        part = rng.integers(1, 4, rng.integers(20, 300))
        s = np.concatenate([part[rng.integers(0, 20) :] for _ in range(30)])
        raw = bytes(s.astype(np.uint8))
        for depth in (1, 2, 4):
            order = suffix_order(s, depth)
            heads = [raw[i : i + 3**depth] for i in order]
            assert sorted(order) == list(range(len(s))) and heads == sorted(heads)


# operator 5 ---------------------------------------------------------------------------------------

def test_shards_follow_the_curve(docs, edge, empty):
    from retainer.llm.hilbert import hilbert_index, shard

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert_index(grid, 3)
    steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
    assert sorted(index) == list(range(512)) and (steps == 1).all()
    for table in (docs, edge):
        source = table.select("doc_id", "text").collect()
        got = shard(table).toPandas()
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source)
        assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
        counts = got.groupby("shard").slot.agg(list).reindex(range(16)).map(lambda x: x if isinstance(x, list) else [])
        assert all(sorted(x) == list(range(len(x))) for x in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
        order = got.sort_values(["shard", "slot"]).curve.tolist()
        assert order == sorted(order) and set(got["law"]) == {"rows"} and got.grown_shard.isna().all()
    assert shard(empty).count() == 0


def test_shard_files_are_pruned(spark, docs, tmp_path):
    from retainer.llm import hilbert

    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pow(2, id % 12) as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("l"), (F.floor(F.col("id") / 12) % 4).cast("string"))).alias("lang"))
    sharded = hilbert.shard(rows).cache()
    hilbert.write(sharded, f"{tmp_path}/s")
    every = spark.read.parquet(f"{tmp_path}/s/rows")
    assert sorted(every.select(sharded.columns).collect(), key=str) == sorted(sharded.collect(), key=str)
    hot = sharded.join(rows.filter("source = 'hot'").select("doc_id"), "doc_id").select("source_cell").distinct().collect()
    assert [tuple(r) for r in hot] == [(0,)]
    for cells in ({"source_cell": (0, 0), "size_cell": (1, 3)}, {"size_cell": (9, 11)}, {"lang_cell": (8, 20), "source_cell": (12, 31)}):
        got = hilbert.read_within(spark, f"{tmp_path}/s", **cells)
        want = sharded.filter(" and ".join(f"{c} between {a} and {b}" for c, (a, b) in cells.items()))
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect()) != []
        assert len(got.inputFiles()) < len(every.inputFiles())
    assert hilbert.read_within(spark, f"{tmp_path}/s", size_cell=(30, 31)).count() == 0
    hilbert.write(hilbert.shard(rows.limit(0)), f"{tmp_path}/none")
    assert hilbert.read_within(spark, f"{tmp_path}/none", size_cell=(0, 31)).collect() == []
    # levels by falling count: each starts where the shares before it end
    counts = {r["source"]: r["count"] for r in docs.filter("source is not null").groupBy("source").count().collect()}
    before, want = 0, {}
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        want[name] = before * 32 // sum(counts.values())
        before += n
    assert {r["level"]: r["cell"] for r in hilbert.levels(docs, "source").collect()} == want


# operator 6 ---------------------------------------------------------------------------------------

def test_ppm_equals_a_plain_trie(docs, edge, empty):
    from retainer.llm.ppm import score

    for table, few in ((docs, 15), (edge, 99)):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
        words, trie, ends = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(5)], 0
        for i, b in rows:
            if i is None or held[i]:
                continue
            words.update(WORD.findall(b.translate(LOWER)))
            ends += 1
            s = b"\0\0\0\0" + b + b"\0"
            for p in range(4, len(s)):
                for j in range(5):
                    trie[j][s[p - j : p]][s[p]] += 1
        total, kinds = sum(words.values()) + ends, len(words) + 1

        def log10p(context, byte):
            out, excluded = 0.0, set()
            for j in (4, 3, 2, 1, 0):
                left = {k: v for k, v in trie[j].get(context[4 - j :], {}).items() if k not in excluded}
                n, q = sum(left.values()), len(left)
                if byte in left:
                    return out + math.log10(left[byte] / (n + q))
                if n:
                    out += math.log10(q / (n + q))
                excluded |= set(trie[j].get(context[4 - j :], {}))
            return out - math.log10(256 - len(excluded))

        got = collections.defaultdict(list)
        for r in score(table).collect():
            got[r["doc_id"], r["n_tokens"]].append(r)
        for n, (i, b) in enumerate(rows):
            w = WORD.findall(b.translate(LOWER))
            r = got[i, len(w) + 1].pop()
            base = sum(math.log10((words[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
            assert (r["n_known"], r["train_tokens"]) == (sum(x in words for x in w) + 1, total)
            assert r["held_out"] == (None if i is None else held[i]) and math.isclose(r["base_score"], base, rel_tol=1e-9)
            if n < few:
                s = b"\0\0\0\0" + b + b"\0"
                assert math.isclose(r["score"], sum(log10p(s[p - 4 : p], s[p]) for p in range(4, len(s))), rel_tol=1e-9)
    assert score(empty).count() == 0


def test_rows_that_share_an_id_are_dealt_by_their_text(spark, monkeypatch):
    from retainer.llm import ppm

    kept, materialize = {}, ppm.materialize
    monkeypatch.setattr(ppm, "materialize", lambda rows, name: kept.setdefault(name, materialize(rows, name)))
    table = spark.createDataFrame([(i, f"word {n}") for n in range(60) for i in (None, 7)], "doc_id long, text string")
    assert ppm.score(table).count() == 120
    assert kept["ppm-asked"].select("g").distinct().count() == 8


# operators 7 and 9 ----------------------------------------------------------------------------------

VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (50, [1.0, 0.1]), (6, [1.0]), (None, [1.0, 1.0]),
           (100, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, []), (9, [float("inf"), 1.0]), (150, [1e-30, 1e-30])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "rep", "n", "shard")})


def test_nearest_recall_and_edges(spark, vectors):
    from retainer.llm.cross_polytope import nearest

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = nearest(table, table.filter("vec_id % 50 = 0")).toPandas()
    rows = table.toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    size, hit, total = np.sqrt((x * x).sum(axis=1)), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (size * size[q])
        s[q] = -9
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
        hit, total = hit + len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:5]])), total + 5
    assert hit / total >= 0.9
    got = nearest(vectors, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [
        (50, 1, 1), (50, 2, 2), (50, 3, 7), (50, 4, 150), (150, 1, 50), (150, 2, 1), (150, 3, 2), (150, 4, 7)]
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_ties_of_many_multiples_go_to_smaller_ids(spark):
    """Multiples of a vector are classes of their own with the same cosine."""
    from retainer.llm.cross_polytope import nearest

    rng = np.random.default_rng(3)
    v, noise = rng.normal(size=16), rng.normal(size=(2, 16))
    rows = [(int(i), (v * 2.0 ** e).tolist()) for i, e in zip(rng.permutation(200), range(-100, 100), strict=True)]
    table = spark.createDataFrame([*rows, *((1000 + i, (v + 0.1 * n).tolist()) for i, n in enumerate(noise))], "vec_id long, embedding array<double>")
    got = nearest(table, table.filter("vec_id in (7, 1000)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [*((7, i) for i in range(5)), *((1000, i) for i in range(5))]


def test_ids_with_several_vectors(spark):
    """Each vector of a repeated id is a node of its own: nearest rows and links equal plain forms over all rows."""
    from retainer.llm.cross_polytope import nearest
    from retainer.llm.hnsw import near_duplicates

    rng = np.random.default_rng(17)
    a, b = rng.normal(size=(2, 16))
    near_b = b + rng.normal(size=16) * 0.02
    rows = [(1, a), (1, b), (3, near_b), (50, a), (50, b), (50, b), *((60 + i % 4, v) for i, v in enumerate(rng.normal(size=(12, 16))))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(table, block=4).collect())
    want = [(1, 1, 1, True), (1, 2, 1, True), (3, 2, 1, False), (50, 1, 1, False), (50, 2, 1, False), (50, 2, 1, False)]
    assert got == sorted(want + [(60 + i % 4, 0, 60 + i % 4, True) for i in range(12)])
    got = nearest(table, table.filter("vec_id in (50, 61)"), k=4).orderBy("query_id", "rank").collect()
    kinds = {(i, tuple(v)) for i, v in rows}
    for q in (50, 61):
        best = sorted(min((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i) for j, w in kinds if j == q) for i, v in kinds if i != q)[:4]
        mine = [r for r in got if r["query_id"] == q]
        assert [(r["rank"], r["vec_id"]) for r in mine] == [(n + 1, i) for n, (_, i) in enumerate(best)]
        assert np.allclose([r["score"] for r in mine], [-s for s, _ in best])


def test_a_query_id_with_many_vectors_finds_the_smallest_others(spark):
    from retainer.llm.cross_polytope import nearest

    x = np.eye(16)[:9].tolist()                 # cosines of 1 and 0 without rounding
    rows = [(50, v) for v in x] + [(100 - i, v) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(table, table.filter("vec_id = 50"), k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [92, 93, 94] and all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_vector_links_equal_brute_force(spark, vectors):
    from retainer.llm.hnsw import near_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:3].repeat(40, axis=0) + rng.normal(size=(120, 16)) * 0.12, base[:2]]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    want = components_of(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    for r in near_duplicates(table, block=50, least_shards=3).collect():
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[r["vec_id"]].sum() - 1, want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(vectors).collect()}
    assert {(1, 3, 1), (2, 3, 1), (7, 3, 1), (50, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None), (100, 0, 100), (150, 0, 150)} <= got
    assert near_duplicates(vectors).count() == len(VECTORS) and near_duplicates(vectors.limit(0)).count() == 0


def test_graph_search_finds_what_exact_search_finds():
    from retainer.llm.hnsw import Graph, links, unit

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:5].repeat(60, axis=0) + rng.normal(size=(300, 24)) * 0.1])
    graph = Graph.build(unit(x))
    got = links(graph, x, x, graph.missed(32), 32, 0.95, 64)
    u = unit(x).astype(float)
    assert all(set(a) == set(np.flatnonzero(b)) for a, b in zip(got, u @ u.T >= 0.95))


def test_building_a_graph_holds_few_pairs_of_vectors_at_once():
    import tracemalloc

    from retainer.llm.hnsw import Graph, unit

    x = unit(np.random.default_rng(4).normal(size=(3000, 256)))
    tracemalloc.start()
    Graph.build(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6, peak


def test_graphs_are_sent_a_few_at_a_time(spark, monkeypatch):
    """More shards than one round takes, and more blocks than one a task, give the links of plain search; no graph is shuffled."""
    from retainer.llm import hnsw

    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 12))
    x = np.concatenate([base, base[:4].repeat(10, axis=0) + rng.normal(size=(40, 12)) * 0.05])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rounds, plain = [], hnsw._query
    monkeypatch.setattr(hnsw, "_query", lambda *more: (rounds.append(len(more[-1].value)), plain(*more))[1])
    monkeypatch.setattr(hnsw, "GRAPH_BYTES", 12_000)
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(table, block=16, shard_rows=20).collect()}
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    assert [got[i] for i in range(len(x))] == [int(n) - 1 for n in near.sum(axis=1)]
    assert sum(rounds) >= 4 and max(rounds) == 1


# operator 8 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("merge_rows", [4096, 8])
def test_pieces_cover_every_token_once(docs, edge, empty, merge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from retainer.llm.packing import pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (docs.repartition(5), edge):
        got = pack(table, merge_rows=merge_rows, most_open=16 if merge_rows > 64 else 2).toPandas()
        ends = got.sort_values(["sequence_id", "offset"])
        assert (ends.groupby("sequence_id").length.cumsum() - ends.length == ends.offset).all() and (ends.offset + ends.length).max() <= 2048
        spans = collections.defaultdict(list)
        for r in got.itertuples():
            spans[-1 if r.doc_id != r.doc_id else int(r.doc_id)].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        want = collections.defaultdict(list)
        for r in table.select("doc_id", "text").collect():
            want[-1 if r["doc_id"] is None else r["doc_id"]].append(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4"))
        for i, many in want.items():
            assert sum(n for _, n, _, _ in spans[i]) == sum(map(len, many))
            if len(many) == 1:
                at = 0
                for start, n, crc, whole in sorted(spans[i]):
                    assert start == at and whole == len(many[0]) and zlib.crc32(many[0][start : start + n].tobytes()) == crc
                    at += n
        if table is not edge:
            size = got.groupby("sequence_id").length.sum()
            assert (2048 - size).sum() / size.sum() < 0.1
    assert pack(empty).count() == 0


# operator 10 --------------------------------------------------------------------------------------

def word_sets(rows, words):
    out = {}
    for i, b in rows:
        w = WORD.findall(b.translate(LOWER))
        out[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    return out


def near_pairs(sets):
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                yield i, j


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(docs, edge, empty, words):
    from retainer.llm.minhash_odd import near_duplicates

    for table in (docs, edge):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
        sets = word_sets([r for r in rows if r[0] is not None], words)
        want = components_of(sets, near_pairs(sets))
        got = near_duplicates(table, words=words).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(empty, words=words).count() == 0


def test_near_copies_that_the_pivot_does_not_reach(spark):
    """A chain: each text is near the next, few are near the first, so buckets stay open after the first round."""
    from retainer.llm.minhash_odd import near_duplicates

    rng = np.random.default_rng(4)
    text, rows = [f"w{i}" for i in rng.integers(0, 10**6, 300)], []
    for i in range(60):
        text = list(text)
        for j in rng.integers(0, 300, 9):
            text[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = word_sets([(i, t.encode()) for i, t in rows], 2)
    want = components_of(sets, near_pairs(sets))
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(table, block=8).collect()} == want


def test_ids_with_several_texts_link_each_of_them(spark):
    from retainer.llm.minhash_odd import near_duplicates

    rng = np.random.default_rng(3)
    a, b = ([f"{p}{x}" for x in rng.integers(0, 10**6, 200)] for p in "ab")
    texts = [(1, a), (1, b), (2, a[1:]), (3, b[1:]), (4, a[2:]), (1, a), (5, ["B" + x[1:] for x in b])]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(rows).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_template_pages_make_no_areas(spark, monkeypatch):
    """Pages that share two thirds of their text are no candidates; chains and near copies among them are found."""
    from retainer.llm import minhash_odd

    rng = np.random.default_rng(5)
    template = [f"t{x}" for x in rng.integers(0, 10**6, 400)]
    pages = [template + [f"p{x}" for x in rng.integers(0, 10**9, 200)] for _ in range(200)]
    for i in range(6):  # a chain: each page like the next, the ends unlike
        pages.append(pages[-1][:-60] + [f"q{x}" for x in rng.integers(0, 10**9, 60)] if i else pages[7][:])
    rows = [(i, " ".join(w)) for i, w in enumerate(pages)]
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, w in enumerate(pages)}
    linked = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    blocks, plain = [], minhash_odd._rest
    monkeypatch.setattr(minhash_odd, "_rest", lambda *a: blocks.append(0) or plain(*a))
    got = {r["doc_id"]: r["component_id"] for r in minhash_odd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(list(sets), linked) and len(linked) >= 6 and blocks


def test_odd_sketch_estimates_similarity():
    from retainer.llm.minhash_odd import Sketcher, most_differing

    rng = np.random.default_rng(6)
    sketcher = Sketcher(32, 5)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * share)
        counts = []
        for _ in range(20):
            both, a, b = (rng.integers(0, 2**63, m).astype(np.uint64) for m in (n, (1000 - n) // 2, (1000 - n) // 2))
            s = np.array([sketcher.samples(np.concatenate([both, x])) for x in (a, b)])
            odd = sketcher.odd(s).view(np.uint64)
            counts.append(np.bitwise_count(odd[0] ^ odd[1]).sum())
        assert abs(np.mean(counts) - most_differing(160, share)) < 8


# components -----------------------------------------------------------------------------------------

def test_components_of_chains_hubs_and_nothing(spark):
    from retainer.llm.graph import components

    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 6000), (6000, 6500), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    nodes = {x for e in edges for x in e}
    assert got == components_of(nodes, edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
