"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A run of texts is one flat byte array. Its words (pre-tokens) are cut by numpy
passes over the classes of its characters and looked up by 64-bit hashes in a
bounded per-worker table. All words of a run that are not known yet lie in one
flat symbol array: in a round the lowest rank of each word is taken and all its
places are merged at once, words without a mergeable pair leave, and the ranks
of the pairs that a merge has made are found by binary search over the sorted
pair keys. A word of very many bytes would take very many rounds; it is merged
alone, from a heap of its pairs, in near-linear time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .bytehash import chunks, prefix, span_hash

#: Words kept by a worker; beyond this the table is emptied and fills anew.
TABLE_WORDS = 1_000_000
#: Words of more bytes than this are merged alone.
LONG_WORD = 256
#: Classes of characters that pre-tokens tell apart.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Endings that are words of their own after an apostrophe (fixed by the vocabulary's format).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_NO_RANK = np.iinfo(np.int64).max
_U = np.uint64


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_SPACE, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            # a run of this string may step over the surrogates, which no text has
            out[a : b + 1] = kind
    return out


def pretokens(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the words of UTF-8 ``data``; no word goes across ``breaks``.

    Words are runs of letters, of numbers or of other signs, each with one space
    before it, and runs of white space without the character that is the last
    before a word. Endings after an apostrophe that begins a word stand alone.
    """
    table = _classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = np.concatenate((data, np.zeros(3, np.uint8)))
        b = [more[lead + k].astype(np.int64) for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
        three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
        k = table[np.where(size == 2, two, np.where(size == 3, three, four))]
        kind[lead] = k
        kind[lead + 1] = k
        for n in (3, 4):
            kind[lead[size >= n] + n - 1] = k[size >= n]
    start = np.empty(len(data) + 1, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[breaks] = True
    start |= first
    # the last white space before a word: a space joins the word, any other stands alone
    after = np.flatnonzero(start[1:-1] & ~first[1:-1] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)) + 1
    joined = data[after - 1] == 32
    start[after[joined]] = False
    last = after - 1
    for _ in range(2):
        last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
    start[last] = True
    quote = np.flatnonzero((data[:-1] == 39) & start[:-2] & ~first[1:-1] & (kind[1:] == _LETTER))
    if len(quote):
        more = np.concatenate((data, np.zeros(2, np.uint8)))
        whole = np.concatenate((first, np.ones(2, bool)))
        for ending in ENDINGS:
            hit = quote
            for k, c in enumerate(ending.encode(), 1):
                hit = hit[(more[hit + k] == c) & ~whole[hit + k]]
            start[hit + 1] = False
            start[hit + 1 + len(ending)] = True
    return np.flatnonzero(start[:-1])


class _Table:
    """Numbers of 64-bit keys by open addressing."""

    def __init__(self, log2: int):
        self.mask = (1 << log2) - 1
        self.keys = np.zeros(1 << log2, np.uint64)
        self.number = np.full(1 << log2, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = (keys & _U(self.mask)).astype(np.int64)
        out = self.number[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(left):
            at = (at[left] + 1) & self.mask if len(at) == len(out) else (at + 1) & self.mask
            out[left] = got = self.number[at]
            on = (self.keys[at] != keys[left]) & (got >= 0)
            left, at = left[on], at[on]
        return out

    def add(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct keys that are not there."""
        at = (keys & _U(self.mask)).astype(np.int64)
        while len(keys):
            free = self.number[at] < 0
            self.number[at[free]] = number[free]
            mine = self.number[at] == number
            self.keys[at[mine]] = keys[mine]
            keys, number, at = keys[~mine], number[~mine], (at[~mine] + 1) & self.mask


class ByteBpe:
    """A vocabulary file with its encoder and decoder."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.joined = keys[order], order.astype(np.int64), joined[order]
        #: What a pair of this rank becomes.
        self.made = joined
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelt = [b""] * size
        for token, i in vocab.items():
            spelt[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, i in self.special.items():
            spelt[i] = token
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_len = np.array([len(b) for b in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_len) - self.spelt_len
        self.find_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.table_words = table_words
        self._clear()

    def _clear(self) -> None:
        # twice as many places as words of a full table and of one more run, which has 2**20 bytes or is one text
        self.table = _Table((2 * (self.table_words + (1 << 20))).bit_length())
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)
        self.n_words = 0

    # -- merging ---------------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NO_RANK)

    def merge_words(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``length`` bytes, given as flat byte ids one after another, and the number of each word's ids."""
        n = len(length)
        word = np.repeat(np.arange(n), length)
        done_sym, done_word = [], []
        big = np.flatnonzero(length > LONG_WORD)
        if len(big):
            edge = np.concatenate(([0], np.cumsum(length)))
            for w in big.tolist():
                ids = self._merge_long(sym[edge[w] : edge[w + 1]])
                done_sym.append(ids)
                done_word.append(np.full(len(ids), w))
            rest = np.repeat(length <= LONG_WORD, length)
            sym, word = sym[rest], word[rest]
        # rank[i] is that of the pair of i and i + 1
        rank = np.full(len(sym), _NO_RANK)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            open_word = least != _NO_RANK
            live = np.repeat(open_word, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                least, size = least[open_word], size[open_word]
                if not len(sym):
                    break
            take = rank == np.repeat(least, size)
            # of overlapping places (x x x) every second one from the left is merged
            where = np.flatnonzero(take)
            run = np.ones(len(where), bool)
            run[1:] = (np.diff(where) > 1) | (word[where[1:]] != word[where[:-1]])
            begin = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
            where = where[(where - begin) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            to = np.cumsum(keep)[where] - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # only pairs with a merged symbol are new
            new = np.zeros(len(sym), bool)
            new[to] = True
            new[to[to > 0] - 1] = True
            fresh = np.flatnonzero(new)
            rank[fresh] = _NO_RANK
            fresh = fresh[fresh < len(sym) - 1]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self._ranks(sym[fresh], sym[fresh + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n)

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """Ids of one word, merging the least rank and there the leftmost place first."""
        rank_of = self.rank_of
        first = self._ranks(sym[:-1], sym[1:])
        heap = [r << 40 | i for i, r in enumerate(first.tolist()) if r != _NO_RANK]
        heapq.heapify(heap)
        made, ids, n = self.made, sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << 40) - 1
        while heap:
            x = heapq.heappop(heap)
            i, r = x & place, x >> 40
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank_of.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    @property
    def rank_of(self) -> dict[int, int]:
        """Rank by pair key; made when a long word is first met."""
        got = self.__dict__.get("_rank_of")
        if got is None:
            got = self.__dict__["_rank_of"] = dict(zip(self.keys.tolist(), self.rank.tolist()))
        return got

    # -- encoding --------------------------------------------------------
    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table's number of each word; words that are not there are merged first."""
        h = span_hash(prefix(data), start, end)
        got = self.table.find(h)
        lost = np.flatnonzero(got < 0)
        if not len(lost):
            return got
        keys, first, which = np.unique(h[lost], return_index=True, return_inverse=True)
        s, size = start[lost[first]], end[lost[first]] - start[lost[first]]
        ids, n = self.merge_words(self.byte_id[gather(data, s, size)], size)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n_words + len(keys) > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            self.len = np.concatenate((self.len, np.zeros_like(self.len)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n_words : self.n_words + len(keys)] = self.used + np.cumsum(n) - n
        self.len[self.n_words : self.n_words + len(keys)] = n
        number = np.arange(self.n_words, self.n_words + len(keys), dtype=np.int32)
        self.table.add(keys, number)
        self.used += len(ids)
        self.n_words += len(keys)
        got[lost] = number[which]
        return got

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of UTF-8 ``data`` (``starts`` as from ``chunks``), and the number of ids of each."""
        n_texts = len(starts) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        if self.n_words > self.table_words or 2 * (self.n_words + len(data)) > len(self.table.keys):
            self._clear()
            if 4 * len(data) > len(self.table.keys):  # one text that is longer than a run
                self.table = _Table((4 * len(data)).bit_length())
        breaks, fixed = starts, []
        raw = data.tobytes()
        if self.find_special and any(t in raw for t in self.special):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                fixed += [(a + m.start(), a + m.end(), self.special[m[0]]) for m in self.find_special.finditer(raw[a:b])]
            breaks = np.concatenate((starts, np.array([x[:2] for x in fixed], np.int64).ravel())) if fixed else starts
        start = pretokens(data, breaks)
        end = np.append(start[1:], len(data))
        number = self._numbers(data, start, end)
        at, n = self.at[number], self.len[number]
        if fixed:
            # the words of a special token are dropped but for the first, which becomes its id
            keep = np.ones(len(start), bool)
            for a, b, i in fixed:
                w, x = np.searchsorted(start, (a, b))
                keep[w + 1 : x] = False
                if self.used == len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
                self.flat[self.used] = i
                at[w], n[w] = self.used, 1
                self.used += 1
            start, at, n = start[keep], at[keep], n[keep]
        per_word = np.concatenate(([0], np.cumsum(n)))
        edge = per_word[np.searchsorted(start, starts)]
        return gather(self.flat, at, n), np.diff(edge)

    # -- decoding --------------------------------------------------------
    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ``n`` ids; broken sequences become U+FFFD."""
        size = self.spelt_len[ids]
        data = gather(self.spelt, self.spelt_at[ids], size).tobytes()
        end = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))].tolist()
        parts = [data[a:b] for a, b in zip(end[:-1], end[1:])]
        return parts if _valid(data, end) else [p.decode("utf-8", "replace").encode() for p in parts]


def _valid(data: bytes, edge: list[int]) -> bool:
    """Whether all parts of ``data`` are UTF-8, each by itself."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return not any(data[a] & 0xC0 == 0x80 for a in edge if a < len(data))


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges ``at`` .. ``at + n`` of ``flat``, one after another."""
    total = int(n.sum())
    return flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, loaded once in a worker."""
    return ByteBpe(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text: str = "text", limit: int = 1 << 20):
    """Yield ``(batch, first row, ids, ids per text)`` over bounded runs of rows; bytes that are no UTF-8 are read as U+FFFD."""
    bpe = load(path)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        for first, data, starts in chunks(col, limit):
            raw, edge = data.tobytes(), starts.tolist()
            if not _valid(raw, edge):
                texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(edge[:-1], edge[1:])]
                data = np.frombuffer(b"".join(texts), np.uint8)
                starts = np.cumsum([0, *map(len, texts)])
            ids, n = bpe.encode(data, starts)
            yield batch, first, ids, n


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out array<int>``: the ids of ``text`` under the vocabulary at ``path``.

    Null and empty texts get an empty array. All other columns are kept;
    a column already named ``out`` is replaced. No shuffle.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, ArrayType(IntegerType()))

    def run(batches):
        for batch, first, ids, n in encoded_batches(batches, path, text):
            part = batch.slice(first, len(n))
            edge = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            arr = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, arr], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Add ``out string``: the text of the ids in ``ids``; null ids give an empty text."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, "string")

    def run(batches):
        bpe = load(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            n = np.array([0 if v is None else v for v in pc.list_value_length(col).to_pylist()], np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [b.decode() for b in bpe.decode(flat, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding ``text``.

    Null texts count as empty (no ids, digests of nothing); rows with a null
    doc_id and repeated rows are encoded like any other. Other columns are not read.
    """

    def run(batches):
        bpe = load(path)
        for batch, first, ids, n in encoded_batches(batches, path):
            raw = ids.astype("<u4").tobytes()
            end = (np.concatenate(([0], np.cumsum(n))) * 4).tolist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(end[:-1], end[1:])]
            back = [hashlib.sha256(b).hexdigest() for b in bpe.decode(ids, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(n)), pa.array(n), pa.array(sha), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
