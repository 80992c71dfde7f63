"""SentencePiece coding, collocations and whitening against the library and brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factgrid.llm import collocations, pieces, queries, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# -- pieces -------------------------------------------------------------------
def odd_texts():
    rng = random.Random(5)
    some = ["▁", " ", "  ", "a", "the", "\n", "\r", "é", "日", "😀", "{", "}", ";", "\x07", "ing", "Q", "<s>", "<0x41>", "\x00"]
    made = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [None, "", " ", "  ", "▁", "a ", " a", "\n\n x\t", "x" * 3000, " " * 500, "日本語" * 700, "é" * 70, "one two " * 30000, *made, *made[:5]]


def test_pieces_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(odd_texts())], "doc_id long, text string, token_ids int")
    assert pieces.differences(df, MODEL).isEmpty()
    got = pieces.encode(df, MODEL, out="Token_Ids").collect()
    assert len(got) == df.count() and all(r["Token_Ids"] == library.encode(r.text or "") and r["token_ids"] == r.doc_id for r in got)
    back = pieces.decode(pieces.encode(df, MODEL), MODEL, out="again")
    assert all(r.again == library.decode(r.token_ids) for r in back.collect())


def test_pieces_of_whole_tables(spark, sf, library):
    docs = queries.table(spark, sf, "documents")
    assert pieces.differences(docs, MODEL).isEmpty()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op11_sentencepiece(spark, sf).collect():
        ids = library.encode(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not texts


def test_any_ids_are_decoded_as_by_the_library(library):
    model, rng = pieces.load(MODEL), random.Random(7)
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(3), rng.randrange(3, 259), rng.randrange(130, 259), rng.randrange(259, 275), rng.randrange(32000))) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids)
    with pytest.raises(IndexError):
        model.decode(np.array([40000]), np.array([1]))


def test_both_agendas_give_the_same(library):
    """One matrix for short parts and a heap for long ones; a full table starts anew."""
    model, rng = pieces.PieceModel(MODEL, table_parts=10), random.Random(9)
    parts = ["▁" + "".join(rng.choice("aeiinrst\n日") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts = [p[1:] for p in parts if p[1:]]
    assert [x.tolist() for x in model.encode(texts)] == [model._agenda("▁" + t) for t in texts] == library.encode(texts)
    assert [x.tolist() for x in model.encode(texts[::-1])] == library.encode(texts[::-1]) and model.encode([]) == []


def test_digest_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a", "y"), (1, None, "z")], "doc_id long, text string, N_TOKENS string")
    got = sorted(pieces.round_trip_digest(df, MODEL).collect(), key=lambda r: r.n_tokens)
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[:4] for r in got[:2]] == [(1, 0, none, none)] * 2 and got[2].doc_id is None and got[2].n_tokens == 1
    assert pieces.round_trip_digest(df.limit(0), MODEL).count() == 0


# -- collocations -------------------------------------------------------------
def brute(rows, least, longest=4, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, all_f in f.items():
        often = {g: c for g, c in all_f.items() if c >= least}
        cands = {g: c for g, c in often.items() if len(g) > 1}
        over = Counter()
        for g, c in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    over[g[i : i + k]] = max(over[g[i : i + k]], c)
        kept = []
        for g, a in cands.items():
            if 100 * over[g] >= 80 * a and over[g]:
                continue
            s, _, l, r = min((2000000 * a // (often[g[:k]] + often[g[k:]]), k, often[g[:k]], often[g[k:]]) for k in range(1, len(g)))
            kept.append((-s, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "gamma", "delta", "é", "日本", "x" * 300, "y" * 300, "to", "be", "of"]
    rows = [(rng.choice(("en", "de", None, "und", "")), rng.choice((" ", "  ", "\t")).join(rng.choices(vocabulary, (9, 8, 7, 1, 3, 3, 2, 2, 6, 6, 1))[0] + rng.choice(("", "", "", "", ".", ",\n", "?")) for _ in range(rng.randint(0, 90)))) for _ in range(400)]
    return [*rows, ("en", None), ("en", ""), (None, " \t.,"), ("en", "to be " * 20000), ("fr", "of the end. " * 40), *rows[:3]]


def compare(spark, rows, **given):
    df = spark.createDataFrame([(i, lang, t, 0) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, score int").repartition(3)
    got = collocations.collocations(df, **given)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_collocations_against_brute_force(spark, phrases):
    got = compare(spark, phrases)
    assert got == brute(phrases, 30) and {r[0] for r in got} == {"en", "de", "und", "", "fr"} and {len(r[2].split(" ")) for r in got} == {2, 3, 4}
    assert compare(spark, phrases, least=3, longest=3, top=7) == brute(phrases, 3, 3, 7)


def test_collocations_by_small_runs_and_a_full_filter(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)  # many blocks of each bucket
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(collocations, "_filter", lambda level, width: (15, np.full(1 << 12, 255, np.uint8)))  # everything is let through
    assert compare(spark, phrases) == brute(phrases, 30)


def test_filter_places_agree(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(int, r)) for r in rng.integers(-(2**63), 2**63 - 1, (200, 3))]
    level = spark.createDataFrame(rows, "h1 long, h2 long, h3 long")
    for width in (1, 2, 3):
        cols = [np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in range(width)]
        log2, bits = collocations._filter(level, width)
        assert collocations._holds(bits, log2, cols).all()
        assert not collocations._holds(bits, log2, [c + np.uint64(12345) for c in cols]).all()


def test_shared_hashes_are_noticed(spark, phrases, monkeypatch):
    """A frequent word that shares its first hash with another is told, and all words are hashed anew."""
    counts = collocations._Counts(4, collocations._first_hash, 1000)
    counts.add([np.array([7, 7, 7, 8, 8, 9, 9, 9], np.uint64), np.array([1, 1, 2, 3, 4, 5, 5, 5], np.uint64)])
    blocks = spark.createDataFrame([tuple(r.values()) for b in counts.take() for r in b.to_pylist()], collocations.BLOCK)
    got = collocations._gathered(blocks, 2, 2, "h1 long, f long, lang string, n long", collocations._first_hash, shared=True)
    assert sorted((r.h1, r.f) for r in got.collect()) == [(7, -1), (9, 3)]  # no word with hash 8 is frequent
    gathered, calls = collocations._gathered, []

    def first_clashes(*given, **named):
        calls.append(len(calls))
        out = gathered(*given, **named)
        return out.withColumn("f", -F.col("f")) if calls == [0] else out

    monkeypatch.setattr(collocations, "_gathered", first_clashes)
    assert compare(spark, phrases) == brute(phrases, 30) and len(calls) == 5


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)], [("en", "a b a b")]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(df).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(df, longest=5)


# -- whitening ----------------------------------------------------------------
def check_whitened(rows, got, most=8):
    """Against numpy, with exact sums."""
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in good], object)
    n, total = len(x), x.sum(0)
    d = n * x - total
    c = (d / n).astype(float)
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    w = c @ vector / np.sqrt(value)
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, min(most, x.shape[1]) + 1))
    for k, rs in by.items():
        a = sorted((r.deviation, abs(r.whitened), str(r.vec_id)) for r in rs)
        b = sorted((int(v), abs(y), str(i)) for v, y, (i, _) in zip((d * d).sum(1), w[:, k - 1], good))
        assert [(p[0], p[2]) for p in a] == [(p[0], p[2]) for p in b] and np.allclose([p[1] for p in a], [p[1] for p in b], atol=1e-7)
        assert len({np.sign(r.whitened * y) for r in rs for y in [w[[str(g[0]) for g in good].index(str(r.vec_id)), k - 1]] if len({i for i, _ in good}) == len(good)} - {0}) <= 1  # one sign for all rows
        assert {r.n for r in rs} == {n} and all(abs(r.explained - value[k - 1] / (c * c).sum() * n) < 1e-9 for r in rs) and all(r.identity_error < 1e-9 for r in rs)


def test_whitening_of_whole_tables(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    check_whitened(rows, queries.op13_whitening(spark, sf).collect())


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 1.0]), (2**60 + 1, [0.5, 0.5, 0.5]), (None, [0.25, -0.5, 1.5])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows + odd], "vec_id long, embedding array<float>, n int").repartition(3)
    got = whitening.whiten(df).collect()
    assert len(got) == 42 * 3 and {r.vec_id for r in got} >= {2**60 + 1, None}
    check_whitened(rows + odd, got)
    twice = whitening.whiten(df.union(df).repartition(2)).collect()
    assert len(twice) == 84 * 3 and {r.n for r in twice} == {84}
    check_whitened((rows + odd) * 2, twice)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == 2 * len(rows) and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in got} == {(0.0, 0, 0.0, 0.0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], schema)).collect()  # rank 1
    assert {r.whitened for r in flat if r.component > 1} == {0.0} and all(r.identity_error < 1e-9 for r in flat)
    mixed = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0])], schema)).collect()  # each length by itself
    assert {(r.vec_id, r.n) for r in mixed} == {(1, 2), (2, 2), (3, 1)}


def test_exact_sums_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [2.0**41, 1.0]), (2, [-(2.0**41), 2.0]), (3, [2.0**43, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert {i for i, _ in got} == {1, 2} and got[1, 1].deviation is None  # 2^104 does not fit; the third row has no exact place
    assert abs(abs(got[1, 1].whitened) - 1) < 1e-9


# -- SQL ----------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op12_collocations", "whitening_base"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = queries.QUERIES[name](spark, sf).select(*names).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(want.fetchall())
