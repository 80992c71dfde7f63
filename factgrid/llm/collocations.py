"""Phrase collocations by Apriori level-wise passes over the texts.

Level 1 counts words. Each further level broadcasts a filter of the frequent
phrases of the level before and takes a phrase of k words only where the filter
holds both its phrases of k - 1 words. Tasks add up their occurrences and hand
them on as blocks of one bucket of the phrases' hashes; Spark brings the blocks
of a bucket together, whose sums are taken in one task, and phrases that are
not frequent go. The level tables then give the counts of all parts of a
candidate in one join.

Phrases are tuples of 64-bit word hashes. Level 1 counts words by two hashes
and makes sure that no frequent word shares its first hash with any other word
(else all are hashed anew), so tuples stand for spellings, up to words that
agree in 128 bits. The filter is a bitmap with a fixed greatest size: a phrase
that it lets through wrongly costs an entry that the count drops, and no
frequent phrase is lost at any size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import chunks, mix, pair_hash, prefix, span_hash, spans
from .common import stash

#: Bits of a filter: sixteen for each frequent phrase, in whole blocks, at most 8 MB.
FILTER_BITS, BLOCK_LOG2, MOST_LOG2 = 16, 15, 26
#: Phrases that a task holds before it hands them on, and bytes of text for each bucket.
HELD, BUCKET_BYTES = 1 << 19, 1 << 21
#: Words of more bytes than this are hashed by a library function.
LONG_WORD = 256
_U = np.uint64
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(10, 14)]] = True
_OUTSIDE = _CUT.copy()
_OUTSIDE[[32, 9]] = True


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Words:
    """The words of a run of texts: hashes, places, and which of them follow each other inside a piece."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: np.ndarray, seed: int):
        self.low, row, self.start, self.end = spans(data, starts, _OUTSIDE)
        self.row, self.by_row = row, langs
        self.hash = self.hashed(seed)
        cuts = np.concatenate(([0], np.cumsum(_CUT[self.low])))
        #: For each word but the last, whether the next one is in the same piece.
        self.joined = (cuts[self.start[1:]] == cuts[self.end[:-1]]) & (row[1:] == row[:-1])

    def hashed(self, seed: int) -> np.ndarray:
        """A hash of each word and its language."""
        h = span_hash(prefix(self.low ^ np.uint8(seed)), self.start, self.end)
        for w in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            h[w] = int.from_bytes(hashlib.blake2b(self.spelling(w), digest_size=8, key=bytes([seed])).digest(), "little")
        return pair_hash(self.by_row[self.row], h)

    def spelling(self, w: int) -> bytes:
        return self.low[self.start[w] : self.end[w]].tobytes()


def _runs(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[_Words, list[str]]]:
    """Words of bounded runs of rows of (lang, text), with the language of each row."""
    known: dict[str, int] = {}
    for batch in batches:
        for first, data, starts in chunks(batch.column(1)):
            langs = ["und" if x is None else x for x in batch.column(0).slice(first, len(starts) - 1).to_pylist()]
            for x in {*langs}.difference(known):
                known[x] = _lang_hash(x)
            if len(data):
                yield _Words(data, starts, np.array([known[x] for x in langs], np.uint64), seed), langs


#: What tasks hand on, by bucket: counted tuples (columns of hashes one after another), words with their spelling, words of a language.
BLOCK = "bucket int, kind int, lang string, keys binary, counts binary, words binary"
_TUPLES, _SPELT, _TOTAL = range(3)
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
_BLOCK_NAMES = [x.split(" ")[0] for x in BLOCK.split(", ")]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK_TYPES)], names=_BLOCK_NAMES)


def _folded(cols: list[np.ndarray], count: np.ndarray, by: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal tuples become one, in the order of ``by``; only tuples that are equal in every column do."""
    order = np.argsort(by, kind="stable")
    cols, by = [c[order] for c in cols], by[order]
    first = np.ones(len(order), bool)
    first[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in cols))
    at = np.flatnonzero(first)
    return [c[at] for c in cols], np.add.reduceat(count[order], at) if len(at) else count[:0], by[at]


class _Counts:
    """Occurrences of tuples of hashes, added up while they are few enough, then handed on by bucket."""

    def __init__(self, log2: int, key, most: int):
        #: ``key`` gives the hash by which tuples are dealt to 2**log2 buckets; ``most`` tuples are held.
        self.log2, self.key, self.most, self.held, self.n, self.folded = log2, key, most, [], 0, 0

    def add(self, columns: list[np.ndarray]) -> bool:
        """Take up occurrences; whether it is time to hand the sums on."""
        self.held.append((columns, np.ones(len(columns[0]), np.int64)))
        self.n += len(columns[0])
        if self.n - self.folded > self.most:
            self._fold()
        return self.n > self.most

    def _fold(self) -> np.ndarray:
        cols = [np.concatenate(c) for c in zip(*(x for x, _ in self.held))]
        cols, count, by = _folded(cols, np.concatenate([c for _, c in self.held]), self.key(cols))
        self.held, self.n, self.folded = [(cols, count)], len(count), len(count)
        return by

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket = (self._fold() >> _U(64 - self.log2)).astype(np.int64)
            cols, count = self.held[0]
            edge = np.searchsorted(bucket, np.arange((1 << self.log2) + 1))
            for first in range(0, 1 << self.log2, 256):
                rows = []
                for b in range(first, min(first + 256, 1 << self.log2)):
                    cut = slice(edge[b], edge[b + 1])
                    if cut.start < cut.stop:
                        rows.append((b, _TUPLES, None, b"".join(c[cut].tobytes() for c in cols), count[cut].tobytes(), None))
                if rows:
                    yield _blocks(rows)
        self.held, self.n, self.folded = [], 0, 0


def _gathered(parts: DataFrame, width: int, least: int, schema: str, key, shared: bool = False) -> DataFrame:
    """Sums over the blocks of each bucket: ``f`` of frequent tuples (hashes in ``h1`` ..), spellings and totals as they come.

    With ``shared`` tuples are two hashes of a word, of which the first stays;
    one that a frequent word shares with another has -1 for its count.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        kept: list[tuple[list[np.ndarray], np.ndarray]] = []
        spelt: dict[int, tuple[str, bytes]] = {}
        now = None

        def close():
            rows: dict[str, pa.Array] = {}
            if kept:
                cols = [np.concatenate(c) for c in zip(*(x for x, _ in kept))]
                cols, f, _ = _folded(cols, np.concatenate([c for _, c in kept]), key(cols))
                often = f >= least
                if shared:
                    h, n = np.unique(cols[0], return_counts=True)
                    clash = often & (n[np.searchsorted(h, cols[0])] > 1)
                    f = np.where(clash, -1, f)
                rows = {f"h{i}": pa.array(c[often].view(np.int64)) for i, c in enumerate(cols[:1] if shared else cols, 1)} | {"f": pa.array(f[often])}
                yield _rows(rows)
            if spelt:
                lang, word = zip(*spelt.values())
                yield _rows({"h1": pa.array(spelt, pa.int64()), "lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.binary())})
            kept.clear()
            spelt.clear()

        def _rows(given: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            kind = {"lang": pa.string(), "word": pa.binary()}
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kind.get(c, pa.int64())) for c in names], names=names)

        for batch in batches:
            for r in range(batch.num_rows):
                bucket, kind, lang, keys, counts, words = (c[r].as_py() for c in batch.columns)
                if bucket != now:
                    yield from close()
                    now = bucket
                count = np.frombuffer(counts, np.int64)
                if kind == _TUPLES:
                    kept.append(([*np.frombuffer(keys, np.uint64).reshape(width, -1)], count))
                elif kind == _TOTAL:
                    yield _rows({"lang": pa.array([lang]), "n": pa.array(count)})
                else:
                    at = 0
                    for h, size in zip(np.frombuffer(keys, np.int64).tolist(), count.tolist()):
                        spelt[h] = (lang, words[at : at + size])
                        at += size
        yield from close()

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _names(width: int) -> list[str]:
    return [f"h{i}" for i in range(1, width + 1)]


def _tuple_hash(cols: list[np.ndarray]) -> np.ndarray:
    return reduce(pair_hash, cols)


def _first_hash(cols: list[np.ndarray]) -> np.ndarray:
    return mix(cols[0])  # all words that share it meet


# -- level 1 -------------------------------------------------------------
def _level_one(texts: DataFrame, least: int, log2: int) -> tuple[DataFrame, DataFrame, int]:
    """``h1, f`` of frequent words, ``lang, n`` of all, and the seed under which no frequent word shares its hash."""

    most = HELD

    def counted(seed: int) -> DataFrame:
        def run(batches):
            counts, totals = _Counts(log2, _first_hash, most), Counter()
            for words, langs in _runs(batches, seed):
                for x, n in zip(langs, np.bincount(words.row, minlength=len(langs)).tolist()):
                    totals[x] += n
                if len(words.hash) and counts.add([words.hash, words.hashed(255 - seed)]):
                    yield from counts.take()
            yield from counts.take()
            if totals:
                yield _blocks([(_lang_hash(x) % (1 << log2), _TOTAL, x, b"", np.array([n], np.int64).tobytes(), None) for x, n in totals.items() if n])

        return stash(_gathered(texts.mapInArrow(run, BLOCK), 2, least, "h1 long, f long, lang string, n long", _first_hash, shared=True))

    for seed in range(128):
        found = counted(seed)
        if found.where("f < 0").isEmpty():
            return found.where("f is not null").select("h1", "f"), found.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n")), seed
    raise RuntimeError("frequent words share 64-bit hashes under each of 128 hash functions")


# -- filters -------------------------------------------------------------
def _places(hashes: list[np.ndarray], log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of each tuple."""
    x, y = hashes[0], hashes[0] >> _U(7)
    for i, h in enumerate(hashes[1:], 1):
        x = x ^ (h << _U(13 * i) | h >> _U(64 - 13 * i))
        y = y ^ (h << _U(29 - 5 * i) | h >> _U(35 + 5 * i))
    return (x & _U((1 << log2) - 1)).astype(np.int64), ((y >> _U(20)) & _U((1 << log2) - 1)).astype(np.int64)


def _place_columns(width: int, log2: int) -> list[F.Column]:
    """The same in Spark's functions."""
    turn = lambda h, k: F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k))
    x, y = F.col("h1"), F.shiftrightunsigned("h1", 7)
    for i, name in enumerate(_names(width)[1:], 1):
        x = x.bitwiseXOR(turn(F.col(name), 13 * i))
        y = y.bitwiseXOR(turn(F.col(name), 29 - 5 * i))
    all_bits = F.lit((1 << log2) - 1)
    return [x.bitwiseAND(all_bits), F.shiftrightunsigned(y, 20).bitwiseAND(all_bits)]


def _filter(level: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """A bitmap of the frequent phrases, made block by block in Spark."""
    log2 = min(max((FILTER_BITS * level.count()).bit_length(), BLOCK_LOG2), MOST_LOG2)
    bits = level.select(F.explode(F.array(*_place_columns(width, log2))).alias("p"))
    blocks = bits.groupBy(F.shiftright("p", BLOCK_LOG2).alias("b")).agg(F.expr(f"bitmap_construct_agg(p & {(1 << BLOCK_LOG2) - 1})").alias("m"))
    out = np.zeros((1 << (log2 - BLOCK_LOG2), 1 << (BLOCK_LOG2 - 3)), np.uint8)
    for r in blocks.toLocalIterator():  # 4 KB each, 2,048 at most
        out[r["b"]] = np.frombuffer(r["m"], np.uint8)
    return log2, out.ravel()


def _holds(bits: np.ndarray, log2: int, hashes: list[np.ndarray]) -> np.ndarray:
    a, b = _places(hashes, log2)
    on = bits[a >> 3] >> (a & 7).astype(np.uint8) & 1
    return (on & bits[b >> 3] >> (b & 7).astype(np.uint8)).astype(bool)


# -- further levels ------------------------------------------------------
def _level(texts: DataFrame, before: DataFrame, width: int, seed: int, least: int, log2: int) -> DataFrame:
    """Frequent phrases of ``width`` words, whose two phrases of one word less are frequent: ``h1 .. hk, f``.

    The pass for pairs also hands on the spelling of each word that its filter
    holds, once a task or more: rows with ``h1, lang, word`` alone.
    """
    size, bits = _filter(before, width - 1)
    shared, most = texts.sparkSession.sparkContext.broadcast(bits), HELD

    def run(batches):
        counts, told = _Counts(log2, _tuple_hash, most), set()
        for words, langs in _runs(batches, seed):
            h, n = words.hash, len(words.hash) - width + 2
            if width == 2 and len(h):
                yield from spellings(words, langs, told)
            if n < 2:
                continue
            run_of = np.ones(n, bool)
            for i in range(width - 2):
                run_of &= words.joined[i : i + n]
            at = np.flatnonzero(run_of)
            frequent = np.zeros(n, bool)
            frequent[at] = _holds(shared.value, size, [h[i : i + n][at] for i in range(width - 1)])
            both = np.flatnonzero(frequent[:-1] & frequent[1:] & words.joined[: n - 1])
            if len(both) and counts.add([h[both + i] for i in range(width)]):
                yield from counts.take()
        yield from counts.take()

    def spellings(words: _Words, langs: list[str], told: set):
        distinct, first = np.unique(words.hash, return_index=True)
        on = _holds(shared.value, size, [distinct])
        new = [(h, w) for h, w in zip(distinct[on].view(np.int64).tolist(), first[on].tolist()) if h not in told]
        if len(told) > most:
            told.clear()
        told.update(h for h, _ in new)
        by: dict[tuple[int, str], list[tuple[int, bytes]]] = {}
        for h, w in new:
            by.setdefault((h & 15, langs[words.row[w]]), []).append((h, words.spelling(w)))
        if by:  # sixteen buckets' worth of words suffices
            rows = [(b << max(log2 - 4, 0), _SPELT, lang, np.array([h for h, _ in x], np.int64).tobytes(), np.array([len(w) for _, w in x], np.int64).tobytes(), b"".join(w for _, w in x)) for (b, lang), x in by.items()]
            yield _blocks(rows)

    keys = _names(width)
    schema = ", ".join(f"{k} long" for k in [*keys, "f"]) + (", lang string, word binary" if width == 2 else "")
    return stash(_gathered(texts.mapInArrow(run, BLOCK), width, least, schema, _tuple_hash))


def collocations(df: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, cover: int = 80) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``; null and empty texts have no words. Words may
    be of any length; rows with a null or repeated doc_id count each; further
    columns are not read. A language without a phrase of at least ``least``
    occurrences has no rows, an empty table gives none. Equal scores go by
    count, then by the bytes of the phrase. ``longest`` is 2 to 4.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest is 2, 3 or 4")
    texts = df.select("lang", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = max(4, (size // BUCKET_BYTES).bit_length())
    words, totals, seed = _level_one(texts, least, log2)
    levels = [words]
    for width in range(2, longest + 1):
        found = _level(texts, levels[-1], width, seed, least, log2)
        levels.append(found.where("f is not null").select(*_names(width), "f"))
        if width == 2:
            spelt = found.where("word is not null").groupBy("h1").agg(F.first("lang").alias("lang"), F.first("word").alias("word"))

    zero = F.lit(0).cast("long")
    wide = longest

    def key(columns: list) -> F.Column:
        return F.struct(F.lit(len(columns)).alias("w"), *[(columns[i] if i < len(columns) else zero).alias(f"k{i}") for i in range(wide)])

    # every part of every candidate, with what it is of it: (cut, side), or a word's place
    asked = None
    for width in range(2, longest + 1):
        h = [F.col(x) for x in _names(width)]
        parts = [(key(h[:k]), 2 * k) for k in range(1, width)] + [(key(h[k:]), 2 * k + 1) for k in range(1, width)]
        parts += [(key([h[i]]), 100 + i) for i in range(width)]
        rows = levels[width - 1].select(key(h).alias("phrase"), F.col("f").alias("a"), F.explode(F.array(*[F.struct(p.alias("part"), F.lit(role).alias("role")) for p, role in parts])).alias("x"))
        rows = rows.select("phrase", "a", "x.part", "x.role")
        asked = rows if asked is None else asked.unionByName(rows)
    none = F.lit(None)
    counted = levels[0].join(spelt, "h1").select(key([F.col("h1")]).alias("part"), "f", "lang", "word")
    for width in range(2, longest):
        counted = counted.unionByName(levels[width - 1].select(key([F.col(x) for x in _names(width)]).alias("part"), "f", none.cast("string").alias("lang"), none.cast("binary").alias("word")))
    found = asked.join(counted, "part").select("phrase", "a", "role", "f", "lang", "word", none.cast("long").alias("over"))
    # and every longer phrase that a candidate lies in
    for width in range(3, longest + 1):
        h = [F.col(x) for x in _names(width)]
        inner = [key(h[i : i + k]) for k in range(2, width) for i in range(width - k + 1)]
        over = levels[width - 1].select(F.explode(F.array(*inner)).alias("phrase"), F.col("f").alias("over"))
        found = found.unionByName(over, allowMissingColumns=True)

    one = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    cuts = range(1, longest)
    whole = found.groupBy("phrase").agg(
        F.max("a").alias("a"), F.max("over").alias("over"), F.max("lang").alias("lang"),
        *[one(2 * k, "f").alias(f"l{k}") for k in cuts], *[one(2 * k + 1, "f").alias(f"r{k}") for k in cuts],
        *[one(100 + i, "word").alias(f"w{i}") for i in range(longest)],
    )
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"cast(a as decimal(20,0)) * {scale} div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    tried = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]
    kept = whole.where(F.col("over").isNull() | (exact("over") * 100 < exact("a") * cover)).select(
        "lang",
        F.concat_ws(" ", *[F.col(f"w{i}").cast("string") for i in range(longest)]).alias("phrase"),
        "a",
        F.array_min(F.array_compact(F.array(*tried))).alias("best"),
    )
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # a language's phrases are first ranked in 64 groups, of which each hands on no more than the result takes
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("g", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
