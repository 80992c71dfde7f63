"""The text operators against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factgrid.llm import bpe, embeddings, html, lm, minhash, packing, pii, suffix, topk, toxicity
from factgrid.llm.common import connected_components

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def texts(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, short, repeated and long texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 3, 8, 30))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((i, rng.choice((" ", "\n")).join(w)))
    return [*rows, (200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, base[0]), (206, base[0]), (207, "😀 two\x1cwords é"), (208, "long " * 30000), (-1, base[1])]


# -- components ---------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = groups({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in want.items() if i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 MinHash ------------------------------------------------------------------


def near(rows, size):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, c == i) for i, c in groups(ids, links).items()}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(spark, odd, size):
    df = texts(spark, odd).withColumn("n", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size).collect()}
    assert got == near(odd, size)


@pytest.mark.parametrize("rounds,block", [(2, 512), (0, 512), (0, 16)])
def test_minhash_star_without_links_between_copies(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), 18 if i % 3 else 30):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(texts(spark, rows), 2).collect()}
    assert got == near(rows, 2)


def test_minhash_nulls_repeats_empty(spark):
    rows = texts(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")])
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = x[:1500], x[300:]
    got = minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None], np.array([1500]), np.array([1700]))[0]
    assert abs(got - 1200 / 2000) < 0.12
    lone = minhash.estimate(minhash.sketch(x[:900])[None], minhash.sketch(x[1000:])[None], np.array([900]), np.array([1000]))[0]
    assert abs(lone) < 0.03


# -- 2 packing, 8 BPE --------------------------------------------------------------


def test_packing(spark, odd):
    df = texts(spark, [*odd, (None, "x")]).withColumn("length", F.lit(1))
    rows = packing.pack(df, VOCAB).collect()
    tok = Tokenizer.from_file(VOCAB)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in odd} | {None}
    for i, t in odd:
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or n == 0
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(by_doc[i]) == 1)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(df.limit(0), VOCAB).count() == 0


def test_histogram_is_packed_whole_and_tight():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        h = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        got = packing.pack_histogram(h)
        used = np.zeros(1025, int)
        for pattern, times in got:
            assert sum(pattern) <= 1024
            for x in pattern:
                used[x] += times
        assert (used == h).all()
        least = -(-int((h * np.arange(1025)).sum()) // 1024)
        assert sum(t for _, t in got) <= 1.05 * least + 2
    assert sum(t for _, t in packing.pack_histogram(np.bincount([341, 341, 342] * 10, minlength=1025))) == 10


def test_bpe_round_trip(spark, odd):
    rng = random.Random(2)
    letters = list(" \n\t\x0b\x1c\x85 'sdtreabcAZ019²½Ⅷ٣éß漢字😀_-.,!?#") + ["  ", "<|endoftext|>", " the", "'ll", "n't"]
    rows = [*odd, *[(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for i in range(2000)]]
    tok = Tokenizer.from_file(VOCAB)
    df = texts(spark, rows)
    got = {r.doc_id: r for r in bpe.round_trip_digest(df.withColumn("ids_sha256", F.lit(0)), VOCAB).collect()}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    there = bpe.decode(bpe.encode(df, VOCAB), VOCAB, out="again").where("coalesce(text, '') <> again")
    assert there.count() == 0
    assert bpe.round_trip_digest(df.limit(0), VOCAB).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "=-"])
def test_bpe_of_long_unbroken_words(letters):
    rng = random.Random(6)
    tok, own = Tokenizer.from_file(VOCAB), bpe.ByteBpe(VOCAB, table_words=50)
    for n in (255, 256, 257, 3000, 200_000):
        text = "".join(rng.choice(letters) for _ in range(n)).encode()
        ids, count = own.encode(np.frombuffer(text + b" x y" + text[:9], np.uint8), np.array([0, n, n + 13]))
        want = [tok.encode(t.decode(), add_special_tokens=False).ids for t in (text, b" x y" + text[:9])]
        assert ids.tolist() == want[0] + want[1] and count.tolist() == list(map(len, want))


# -- 3 embeddings, 7 top-k -----------------------------------------------------------


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, dims))
    x[-5:] = x[0]
    return x.astype(np.float32)


ODD_VECTORS = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [1.0, 0.0], 1), (906, [1.0] * 16, None)]


@pytest.mark.parametrize("window", [512, 16])
def test_near_vectors(spark, window):
    x = vectors(1, 240)
    x[60:100] = x[60] + 0.01 * np.random.default_rng(9).standard_normal((40, 16))  # a group longer than a window
    label = np.arange(240) % 3
    label[60:100] = 1
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(240)] + ODD_VECTORS + [(None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, window=window).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(a, b) for a in range(240) for b in range(a + 1, 240) if label[a] == label[b] and u[a] @ u[b] >= 0.98]
    n = Counter(i for p in links for i in p)
    want = {i: (n[i], c, c == i) for i, c in groups(range(240), links).items()}
    assert {i: v for i, v in got.items() if i is not None and i < 900} == want
    assert all(got[i] == (0, i, True) for i, _, _ in ODD_VECTORS) and got[None] == (0, None, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_passes_move_no_vectors(spark):
    """What is dealt in passes are ids and hashes; vectors go where a candidate is."""
    x = vectors(3, 60)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], 1) for i in range(60)] * 2, "vec_id long, embedding array<float>, label int")
    folded = df.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).withColumn("at", F.monotonically_increasing_id())
    hashed = embeddings._hash(folded.withColumn("label", F.col("label").cast("long")).withColumn("embedding", F.col("embedding").cast("array<double>")), 3, 4)
    row = hashed.first()
    assert len(row["keys"]) == embeddings.HASH_BITS // 8 and len(row.prefixes) == 4 and len(row.v) == 64
    got = {(r.vec_id, r.n_links) for r in embeddings.near_vectors(df).collect()}  # each row twice
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == {(i, 2 * int((u @ u[i] >= 0.98).sum()) - 1) for i in range(60)}


def test_hashes_at_the_threshold_differ_in_few_bits():
    for bits, cosine in ((128, 0.98), (256, 0.9), (900, 0.98)):
        far, p = embeddings.reach(bits, cosine), math.acos(cosine) / math.pi
        tail = lambda n: sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(n + 1, bits + 1))
        assert tail(far) <= embeddings.MISS < tail(far - 1)
    assert embeddings.reach(128, 1.0) == 0 and embeddings.reach(128, -1.0) == 128
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((400, 32))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    planes = rng.standard_normal((32, 128))
    assert ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1).max() <= embeddings.reach(128, 0.98)


@pytest.mark.parametrize("scale", [10, 1 << 20, 1 << 40])
def test_narrow_queries_and_bounds_by_tile(scale, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    rng = np.random.default_rng(6)
    v, q = np.floor(scale * rng.standard_normal((30, 8))), np.floor(scale * rng.standard_normal((5, 8)))
    packed = topk.narrow(q)
    assert len(packed) == q.size * (2 if scale == 10 else 4 if scale == 1 << 20 else 8) and (topk.wide(packed, 5, 8) == q).all()
    cells, shifts = zip(*(topk.cells_of(x) for x in v))
    bounds = topk._Bounds(np.arange(30).tobytes(), np.array(shifts, np.int32).tobytes(), b"".join(c.tobytes() for c in cells), 8)
    qids = np.array([100, 101, 3, 102, 103])
    exact = np.array([[topk.product(a, b) for b in v] for a in q], np.float64)
    low, high = (np.concatenate([x for _, x in side(qids, q)], axis=1) for side in (bounds.lower, bounds.upper))
    own = np.zeros((5, 30), bool)
    own[2, 3] = True
    assert np.isneginf(low[own]).all() and np.isneginf(high[own]).all()
    assert (low <= exact)[~own].all() and (exact <= high)[~own].all() and [len(i) for i, _ in bounds.lower(qids, q)] == [7, 7, 7, 7, 2]


@pytest.mark.parametrize("block,page", [(2048, 4096), (4, 16)])
def test_top_k(spark, block, page):
    x = vectors(2, 150)
    x[10:20] = x[10]  # ties
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(150)] + [v for v in ODD_VECTORS if v[0] != 906]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = topk.integer_vectors(df)
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 10 = 0"), block=block, page=page).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    q = {i: np.floor(256 * np.array(e, float)).astype(int) for i, e, _ in rows if e and None not in e and np.isfinite(np.array(e, float)).all()}
    want = {}
    for i in (i for i in q if i % 10 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        if best:
            want[i] = {n + 1: (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 == topk.top_k(v, v.limit(0)).count()


@pytest.mark.parametrize("page", [4096, 8])
def test_top_k_of_wide_few_and_repeated_vectors(spark, page):
    rng = np.random.default_rng(3)
    scale = 10.0 ** rng.integers(-2, 38, (60, 1))
    x = (rng.standard_normal((60, 6)) * scale).astype(np.float32)
    x[:4] = 1e9 * rng.standard_normal((4, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [float(c) for c in x[7]])] * 9 + [(200, [1.0]), (201, [2.0]), (201, [3.0]), (202, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("page", F.lit(1)))
    got = {}
    for r in topk.top_k(v, v, page=page).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in e]) for i, e in rows]
    for i, q in dict(ints[::-1]).items():
        best = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in ints if j != i and len(e) == len(q))[:5]
        if i != 201:  # either of its two rows may be the query
            assert sorted(got.get(i, [])) == [(n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(best)], i
    assert 202 not in got and [r[1] for r in sorted(got[200])] == [201, 201]


# -- 4 language model -----------------------------------------------------------------


def test_language_model(spark, odd):
    df = texts(spark, odd).withColumn("score", F.lit("x"))
    for head in (1 << 17, 8):  # all counts in the broadcast table, or nearly none
        got = {r.doc_id: r for r in lm.score_texts(df, lm.by_seventh(), filter_log2=20, head=head).collect()}
        toks = {i: [*words(t), None] for i, t in odd}
        c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
        n = sum(c.values())
        for i, ws in toks.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in c for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), rel_tol=1e-9)
        held = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs help on held-out text
    assert lm.score_texts(df.limit(0), lm.by_seventh(), filter_log2=20).count() == 0
    assert lm.score_texts(texts(spark, [(None, "a b"), (None, "a b")]), lm.by_seventh(), filter_log2=20).count() == 2


def test_scores_are_those_of_the_counts(spark, odd):
    """With a filter far larger than it needs to be, scores equal those of quantised counts held in a table."""
    toks = {i: [b"", *words(t), None] for i, t in odd}
    train = [i for i, _ in odd if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for i in train for w in toks[i][1:])
    two = Counter(p for i in train for p in zip(toks[i], toks[i][1:]))
    n, v = sum(one.values()), len(one)
    level = {c: int(lm.middle(lm.Segment.level(np.array([c])))[0] * 2) / 2 for c in set(two.values())}
    want = {}
    for i, ws in toks.items():
        want[i] = 0.0
        for a, b in zip(ws, ws[1:]):
            prior = len(train) if a == b"" else one[a]
            pair = min(level.get(two[a, b], 0), prior, one[b])
            want[i] += math.log10((pair + lm.MU * (one[b] + 1) / (n + v + 1)) / (prior + lm.MU))
    for spread in (False, True):
        got = {r.doc_id: r.score for r in lm.score_texts(texts(spark, odd), lm.by_seventh(), filter_log2=27, spread=spread).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_filter_grows_with_the_corpus(spark, odd):
    df = texts(spark, odd)
    score = lambda **k: {r.doc_id: r.score for r in lm.score_texts(df, lm.by_seventh(), **k).collect()}
    near, far = score(filter_log2=20), score(filter_log2=20, spread=True)
    assert near.keys() == far.keys() and all(math.isclose(near[i], far[i], rel_tol=1e-9) for i in near)
    few = score(filter_log2=12)  # far less than the corpus needs: no pair may be lost
    assert all(abs(few[i] - near[i]) <= 0.02 * abs(near[i]) for i in near)


def test_broadcast_bound_is_the_sessions(spark):
    assert lm._broadcast_log2(spark) == 26  # 10 MB, as Spark has it
    assert lm.score_texts(texts(spark, [(1, "a b"), (2, None)]), lm.by_seventh()).count() == 2


def test_segment_holds_all():
    rng = np.random.default_rng(1)
    parts = [(rng.integers(0, 2**48, n, dtype=np.uint64), rng.integers(1, 400, n)) for n in (500, 3000)]
    bits = lm.Segment.size(parts, 64)
    seg, cut = lm.Segment.build(parts, bits)
    assert cut == 1 and len(seg) == bits // 8 and lm.Segment.size(parts, 1 << 20) == 1 << 20
    assert all((lm.probe(np.frombuffer(seg, np.uint8), np.zeros(len(k), np.int64), k, bits) > 0).all() for k, _ in parts)


def test_filter_counts():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 2**48, 3000, dtype=np.uint64), rng.integers(1, 400, 3000)
    seg, cut = lm.Segment.build([(keys, counts)], 1 << 20)
    got = lm.probe(np.frombuffer(seg, np.uint8), np.zeros(3000, np.int64), keys, 1 << 20)
    assert cut == 1 and (np.abs(np.log(got / counts)) < math.log(lm.BASE) + 0.1).mean() > 0.99
    others = lm.probe(np.frombuffer(seg, np.uint8), np.zeros(3000, np.int64), keys + np.uint64(1 << 50), 1 << 20)
    assert (others > 0).mean() < 0.02
    small, cut = lm.Segment.build([(keys, counts)], 1 << 12)
    assert cut > 1 and len(small) == 512


# -- 5 toxicity --------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice("alpha beta gamma delta omega sigma kappa".split()) + str(rng.randrange(40)) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["Grublig,", "zapfels", "NORKER!", "snarbent"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 1:
            labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "zapfels norker grublig"), (3, rows[3][1])]
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    df = texts(spark, rows).withColumn("positive", F.lit(1)).withColumn("toxic", F.lit(1))
    got = toxicity.toxicity(df, lab).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    for i in range(1500):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == int(by[i].score >= 0.5)
    wrong = sum(by[i].predicted != (i % 8 == 0) for i in range(1500) if by[i].held_out)
    assert wrong <= 3
    assert by[5000].predicted == 0 == by[5001].predicted
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.toxicity(df.limit(0), lab.limit(0)).count() == 0
    assert toxicity.toxicity(df, lab.limit(0)).agg(F.max("predicted")).first()[0] == 0


@pytest.mark.parametrize("branch", [1, -1])
def test_non_negative_risk(branch):
    """The gradient against differences, above and below the zero of the part that must not be negative."""
    rng = np.random.default_rng(2)
    some = lambda n, low: toxicity._flat([np.unique(rng.integers(low, 8, 4)) for _ in range(n)])
    pos, unl = some(30, 0), some(50, 2)
    w, b = rng.standard_normal(8), 0.3 if branch > 0 else -0.5
    prior = 0.2 if branch > 0 else 0.9
    if branch < 0:
        w = np.abs(w) + 1
        w[2:] = -3.0  # what only positives hold is sure, all else is surely negative: the rest falls below zero
    part, rest, gw, gb = toxicity.risk(w, b, pos, unl, prior)
    assert (rest > 0) == (branch > 0)
    value = lambda w, b: sum(toxicity.risk(w, b, pos, unl, prior)[:2]) if branch > 0 else -toxicity.risk(w, b, pos, unl, prior)[1]
    for k in range(8):
        d = np.eye(8)[k] * 1e-6
        assert abs((value(w + d, b) - value(w - d, b)) / 2e-6 - gw[k]) < 1e-6
    assert abs((value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6 - gb) < 1e-6
    down = toxicity.risk(w - 1e-3 * gw, b - 1e-3 * gb, pos, unl, prior)
    assert down[0] + down[1] < part + rest if branch > 0 else down[1] > rest


# -- 6 personal data ------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_kind(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(t):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(FORMS.items()) for m in re.finditer(p, t or "") if is_kind(kind, m[0]))
    return ",".join(f"{kind}:{b}:{e}" for b, _, e, kind in found)


def test_personal_data(spark, odd):
    rng = random.Random(3)
    letters = list("ab@.- 0123456789+()_%é😀\n") + ["4539578763621486", "10.0.0.1", "255.256.1.1", "a@b.co", "+1 (988) 555-2485", "0000255.1.1.1"]
    rows = [*odd, *[(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(3000)]]
    rows += [(9000, "1 2 " * 9000 + "5" * 20000 + "a" * 20000 + "@b.c " + "x12345 " * 9000)]
    got = {r.doc_id: r for r in pii.personal_data(texts(spark, rows).withColumn("found", F.lit(1))).collect()}
    for i, t in rows:
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(kinds[k] for k in FORMS)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    nothing = pii.personal_data(texts(spark, [(None, "a@b.co"), (1, "x"), (1, "x")])).collect()
    assert sorted(r.spans for r in nothing) == ["", "", "email:0:6"]
    assert pii.personal_data(texts(spark, []).limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"user {i} said contact mail: name{i}@site{i}.org and more") for i in range(20)]
    rows += [(100, "his contact mail: jo.smith99(at)corp and more"), (101, "the year: jo.smith98 and more")]
    df = texts(spark, rows)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert got[100].spans == "email:18:28" and got[100].n_email == 0
    assert got[101].spans == ""
    new = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert new[100] == "his contact mail: [EMAIL](at)corp and more" and new[0] == "user 0 said contact mail: [EMAIL] and more" and new[101] == rows[-1][1]


# -- 9 HTML ---------------------------------------------------------------------------------------


def test_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<!-- ad --><div class='ad-box'>Buy</div><div id=x class='post c%d'><h1>Head &amp; line</h1><p>One <b>two</b>\n three.<br>four<p>Fi<i>ve</i> &lt;6&gt; and quite a long sentence of text here."
        "<div class=comments><p>I disagree with all of this text, dear author.</p></div><form><input><p>Mail</form></div><aside>Side</aside><footer>&copy; foot</footer></body></html>"
    )
    rows = [(i, "http://h.example.com/%d" % i, page % i) for i in range(5)]
    rows += [(10, None, None), (11, "", ""), (12, "http://h.example.com/z", "<p>plain &eacute;<script>x"), (13, "nonsense", "no tags at all < 3"), (14, "http://h.example.com/", "<<<p><div"), (0, "http://h.example.com/0", page % 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = html.extract_pages(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[0] == by[4] == "Head & line One two three. four Five <6> and quite a long sentence of text here."
    assert by[10] == "" == by[11] and by[12] == "plain é" and by[13] == "no tags at all < 3"
    assert html.extract_pages(df.limit(0)).count() == 0


# -- 10 repeats -------------------------------------------------------------------------------------


def repeats(rows):
    first, out = {}, {}
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in docs:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeats(spark, odd, crowd):
    rows = [*odd, (300, "ab" * 500), (301, "ba" * 400), (302, "x" * 49), (303, "x" * 50), (304, "x" * 51), (305, "y" + "x" * 50)]
    df = texts(spark, rows).withColumn("g", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, crowd=crowd, noted_log2=20).collect()}
    assert got == repeats(rows)


def test_repeats_text_and_odd_rows(spark):
    long = "".join(chr(97 + i % 26) for i in range(60))
    df = spark.createDataFrame([(1, long + "é", "k"), (2, "A" + long + "Z", "l"), (None, long, "m"), (3, None, "n"), (4, "", "o")], "doc_id long, text string, lang string")
    got = sorted(suffix.remove_repeats(df, keep_text=True, noted_log2=20).collect(), key=lambda r: r.lang)
    assert [(r.doc_id, r.text, r.lang) for r in got] == [(1, long + "é", "k"), (2, "AZ", "l"), (None, long, "m"), (3, None, "n"), (4, "", "o")]
    assert suffix.remove_repeats(df.limit(0), noted_log2=20).count() == 0


def test_repeats_of_doubled_phrases():
    """A phrase of 20 to 31 bytes twice running in one document and once in another, with the same continuation."""
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    docs = []
    for n in range(20, 32):
        for k in range(600):
            phrase, more = some(n), some(60)
            docs += [pair := [some(30) + 2 * phrase + more, some(30) + phrase + more], pair[::-1]][k % 2]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    data = np.frombuffer(b"".join(docs), np.uint8)
    anchor, _, row, s, e = suffix.segments(data, starts)
    order = np.argsort(anchor, kind="stable")
    row, s, e = row[order], s[order], e[order]
    edge = np.concatenate(([0], np.cumsum(e - s)))
    text = np.concatenate([data[a:b] for a, b in zip(s, e)])
    gone = np.zeros(len(data), bool)
    for w, a, b in zip(*(x.tolist() for x in suffix._bucket_repeats(text, edge, row))):
        gone[s[w] + a : s[w] + b] = True
    want = repeats([(i, d.decode()) for i, d in enumerate(docs)])
    assert [int(gone[a:b].sum()) for a, b in zip(starts, starts[1:])] == [want[i][1] for i in range(len(docs))]


def test_column_order():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 20))) for _ in range(40)]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    who, at, common = suffix.column_order(np.frombuffer(b"".join(parts), np.uint8), starts, depth=8)
    seen = [parts[i][a:] for i, a in zip(who.tolist(), at.tolist())]
    assert seen == sorted(seen) and len(seen) == starts[-1] + 40
    for x, y, c in zip(seen, seen[1:], common[1:].tolist()):
        n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert c == min(n, 8)
