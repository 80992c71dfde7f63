"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is one sequence of symbols, spaces written as U+2581, with one such sign
put before it. Adjacent pairs whose joint spelling is a piece wait in an agenda
ordered by the piece's score and then by place; the best is merged and its new
neighbours enter. Characters that no piece spells become byte pieces.

Where no piece holds the space sign behind another character, no pair can reach
over the beginning of a run of such signs. Texts are then cut there, and each
distinct part goes through its agenda once a worker; otherwise a whole text is
one part. The agendas of all new short parts of a batch are the rows of one
matrix, whose best entries are taken together, one a part and step; a long part
has a heap. Both give the library's ids, to which ``differences`` compares them
in Arrow batches.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .bpe import gather

#: Parts kept by a worker, and characters of them; beyond either the table is emptied and fills anew.
TABLE_PARTS, TABLE_CHARS = 500_000, 1 << 24
SPACE = "▁"
#: Parts of at most so many characters share a matrix; longer ones have a heap each.
WIDTHS = (8, 16, 32, 64)
_NONE = np.iinfo(np.int32).max
#: Fixed values of the model format: kinds of pieces, the merge type, and the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MERGE_TYPE = 2
UNKNOWN_TEXT = " ⁇ "


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = number(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A model file with its encoder and decoder."""

    def __init__(self, path: str, table_parts: int = TABLE_PARTS):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer = dict(x for k, v in model if k == 2 for x in _fields(v))
        normal = dict(x for k, v in model if k == 3 for x in _fields(v))
        self.spelling = [p.get(1, b"").decode() for p in pieces]
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        kind = np.array([p.get(3, NORMAL) for p in pieces])
        if trainer.get(3, 1) != MERGE_TYPE or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or np.isin(kind, (USER, UNUSED)).any():
            raise ValueError("only merge-type models are read that keep texts as they are and have neither user-defined nor unused pieces")
        self.dummy = bool(normal.get(3, 1))
        self.kind = kind
        self.unknown = int(np.flatnonzero(kind == UNKNOWN)[0])
        self.byte_id = {int(self.spelling[i][3:-1], 16): int(i) for i in np.flatnonzero(kind == BYTE)} if trainer.get(35, 0) else {}
        order = {s: n for n, s in enumerate(sorted({score[i] for i in np.flatnonzero(kind == NORMAL)}, reverse=True))}
        self.ids = {self.spelling[i]: i for i in np.flatnonzero(kind == NORMAL).tolist()}
        #: Place of each piece's score among all, the best first; equal scores share one.
        self.rank = {s: order[score[i]] for s, i in self.ids.items()}
        #: Whether texts can be cut before every run of space signs.
        self.parted = not any(SPACE in s.lstrip(SPACE) for s in self.ids)
        self.part = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        spelt = [s.replace(SPACE, " ").encode() for s in self.spelling]
        for i in np.flatnonzero(kind == BYTE).tolist():
            spelt[i] = bytes([int(self.spelling[i][3:-1], 16)])
        for i in np.flatnonzero(kind == CONTROL).tolist():
            spelt[i] = b""
        spelt[self.unknown] = trainer[44] if 44 in trainer else UNKNOWN_TEXT.encode()
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.size = np.array([len(b) for b in spelt], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.leads = np.array([k == NORMAL and s.startswith(SPACE) for k, s in zip(kind.tolist(), self.spelling)])
        self.table_parts = table_parts
        self._clear()
        #: Piece of each single character, and for each pair of pieces that joins to a piece that piece, by sorted key.
        self.letter = np.full(0x110000, -1, np.int32)
        for s, i in self.ids.items():
            if len(s) == 1:
                self.letter[ord(s)] = i
        pairs = {self.ids[s[:k]] << 32 | self.ids[s[k:]]: i for s, i in self.ids.items() for k in range(1, len(s)) if s[:k] in self.ids and s[k:] in self.ids}
        self.pair = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.joined_rank = np.array([self.rank[self.spelling[i]] for i in self.joined.tolist()], np.int32)
        #: Whether every symbol that a merge can meet is a piece, so that pairs of pieces are all pairs.
        self.closed = bool(self.byte_id) and all((self.letter[[ord(c) for c in s]] >= 0).all() for s in self.ids)

    # -- encoding --------------------------------------------------------
    def _clear(self) -> None:
        #: Number of each known part, and where its ids lie in ``flat``.
        self.table: dict[str, int] = {}
        self.flat, self.begin, self.count, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _agenda(self, part: str) -> list[int]:
        """Ids of one part: pairs in order of score, of equal score the leftmost first."""
        rank, sign = self.rank.get, list(part)
        n = len(sign)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [r << 40 | i for i in range(n - 1) if (r := rank(sign[i] + sign[i + 1])) is not None]
        heapq.heapify(waiting)
        place = (1 << 40) - 1
        while waiting:
            x = heapq.heappop(waiting)
            i, r = x & place, x >> 40
            j = after[i]
            if not sign[i] or j >= n or rank(joined := sign[i] + sign[j]) != r:
                continue  # one of the two has been merged otherwise since
            sign[i], sign[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + sign[k])) is not None:
                    heapq.heappush(waiting, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank(sign[h] + joined)) is not None:
                heapq.heappush(waiting, r << 40 | h)
        out: list[int] = []
        for s in filter(None, sign):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.byte_id:
                out += map(self.byte_id.__getitem__, s.encode())
            elif not out or out[-1] != self.unknown:  # unknown neighbours are one
                out.append(self.unknown)
        return out

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each joined pair; pairs that join to none have the rank ``_NONE``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.joined_rank[at], _NONE), self.joined[at]

    def _agendas(self, sign: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of parts of at most ``width`` signs, given as flat piece ids, and the number of each part's ids."""
        n, span = len(size), np.arange(width + 1)
        inside = span[:-1] < size[:, None]
        sym = np.full((n, width), -1, np.int32)
        sym[inside] = sign
        after = np.broadcast_to(span[1:], (n, width)).copy()
        before = np.broadcast_to(span[:-1] - 1, (n, width)).copy()
        waiting, made = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        if width > 1:
            both = np.nonzero(inside[:, 1:])
            waiting[both], made[both] = self._look_up(sym[both], sym[both[0], both[1] + 1])
        row = np.arange(n)
        while True:
            i = waiting[row].argmin(1)  # the first of equal ones
            on = waiting[row, i] != _NONE
            row, i = row[on], i[on]
            if not len(row):
                break
            j = after[row, i]
            sym[row, i] = made[row, i]
            sym[row, j] = -1
            waiting[row, i] = waiting[row, j] = _NONE
            k = after[row, i] = after[row, j]
            in_part = k < size[row]
            r, a, c = row[in_part], i[in_part], k[in_part]
            before[r, c] = a
            waiting[r, a], made[r, a] = self._look_up(sym[r, a], sym[r, c])
            h = before[row, i]
            r, a, c = row[h >= 0], i[h >= 0], h[h >= 0]
            waiting[r, c], made[r, c] = self._look_up(sym[r, c], sym[r, a])
        ids, count = sym[sym >= 0], (sym >= 0).sum(1)
        if len(lost := np.flatnonzero(ids >= len(self.kind))):
            # byte pieces stand for unknown characters
            chars, which = np.unique(ids[lost] - len(self.kind), return_inverse=True)
            as_bytes = [[self.byte_id[b] for b in chr(c).encode()] for c in chars.tolist()]
            many = np.array([len(b) for b in as_bytes])[which]
            count += np.bincount(np.repeat(np.arange(n), count)[lost], many - 1, n).astype(count.dtype)
            times = np.ones(len(ids), np.int64)
            times[lost] = many
            ids = np.repeat(ids, times)
            ids[ids >= len(self.kind)] = np.array([i for b in map(as_bytes.__getitem__, which.tolist()) for i in b])
        return ids, count

    def _learn(self, parts: list[str]) -> None:
        """Put the ids of ``parts`` into the table."""
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sign = self.letter[flat]
        sign = np.where(sign < 0, len(self.kind) + flat.astype(np.int32), sign)  # no pair holds the number of an unknown character
        starts = np.cumsum(size) - size
        left, order, flats, counts = np.ones(len(parts), bool), [], [], []
        for low, width in zip((0, *WIDTHS), WIDTHS) if self.closed else ():
            which = np.flatnonzero((size > low) & (size <= width))
            left[which] = False
            for some in np.array_split(which, -(-len(which) * width // (1 << 18)) or 1):  # at most 2**18 signs a matrix
                ids, n = self._agendas(gather(sign, starts[some], size[some]), size[some], width)
                order.append(some)
                flats.append(ids)
                counts.append(n)
        for w in np.flatnonzero(left).tolist():
            ids = self._agenda(parts[w])
            order.append(np.array([w]))
            flats.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)]))
        n = np.concatenate(counts)
        self.table.update(zip(map(parts.__getitem__, np.concatenate(order).tolist()), range(len(self.count), len(self.count) + len(parts))))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
        self.count = np.concatenate((self.count, n))
        self.flat = np.concatenate((self.flat, *flats))
        self.chars += len(flat)

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.parted or not self.byte_id:  # without byte pieces unknown neighbours of two parts would have to be joined
            return [(SPACE if self.dummy else "") + text.replace(" ", SPACE)]
        if self.dummy and text[0] != " " and "  " not in text and SPACE not in text:
            return [SPACE + w for w in text.split(" ")]
        return self.part.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        if len(self.table) > self.table_parts or self.chars > TABLE_CHARS:
            self._clear()
        parts = [self._parts(t) for t in texts]
        table = self.table
        if new := list({*chain.from_iterable(parts)}.difference(table)):
            self._learn(new)
        edge = np.cumsum([0, *map(len, parts)])
        number = np.fromiter(map(table.__getitem__, chain.from_iterable(parts)), np.int64, edge[-1])
        n = self.count[number]
        return np.split(gather(self.flat, self.begin[number], n), np.concatenate(([0], np.cumsum(n)))[edge[1:-1]])[: len(texts)]

    # -- decoding --------------------------------------------------------
    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ``n`` ids.

        The space sign that begins a text goes once; runs of byte pieces are
        read as UTF-8, each byte that is none becomes U+FFFD; control pieces
        are silent. Ids outside the vocabulary raise an IndexError.
        """
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise IndexError("an id is not in the vocabulary")
        data = gather(self.spelt, self.at[ids], self.size[ids]).tobytes()
        first = np.concatenate(([0], np.cumsum(n)))
        edge = np.concatenate(([0], np.cumsum(self.size[ids])))[first].tolist()
        silent = self.kind[ids] == CONTROL
        leads, odd = self.leads[ids], np.zeros(len(n), bool)
        if silent.any():
            odd[np.searchsorted(first, np.flatnonzero(silent), side="right") - 1] = True
        out = []
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            text = data[a + 1 : b] if self.dummy and n[k] and leads[first[k]] else data[a:b]
            if odd[k] or not _is_utf8(text):
                text = self._decode_slowly(ids[first[k] : first[k + 1]].tolist())
            out.append(text)
        return out

    def _decode_slowly(self, ids: list[int]) -> bytes:
        out, run, begun = [], bytearray(), False
        for i in [*ids, -1]:
            if i >= 0 and self.kind[i] == BYTE:
                run += self.spelt[self.at[i] : self.at[i] + 1].tobytes()
                continue
            if run:
                out.append(_read_bytes(bytes(run)))
                run, begun = bytearray(), True
            if i >= 0 and self.kind[i] != CONTROL:
                piece = self.spelt[self.at[i] : self.at[i] + self.size[i]].tobytes()
                out.append(piece[1:] if self.dummy and not begun and self.leads[i] else piece)
                begun = True
        return b"".join(out)


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _read_bytes(run: bytes) -> bytes:
    """``run`` as UTF-8, every byte that begins no whole character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if _is_utf8(char := run[at : at + size]):
            out.append(char)
            at += size
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """The model at ``path``, loaded once in a worker."""
    return PieceModel(path)


def _texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty; bytes that are no UTF-8 are read as U+FFFD."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, at: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Runs of rows of about ``limit`` characters (one row at least) with their texts and ids."""
    model = load(path)
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, side="right")))
            part = batch.slice(first, last - first)
            texts = _texts(part.column(at))
            yield part, texts, model.encode(texts)
            first = last


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out array<int>``: the ids of ``text`` under the model at ``path``, without begin or end.

    Null and empty texts get an empty array. All other columns are kept; a
    column already named ``out`` is replaced. Rows are not moved.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out, ArrayType(IntegerType()))
    at = kept.index(text)

    def run(batches):
        for part, _, ids in _encoded(batches, path, at):
            edge = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], names=[*kept, out])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Add ``out string``: the text of the ids in ``ids``; null ids give an empty text, a null among them is passed over."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out, "string")
    at = kept.index(ids)

    def run(batches):
        model = load(path)
        for batch in batches:
            rows = [[i for i in r or () if i is not None] for r in batch.column(at).to_pylist()]
            flat = np.array([i for r in rows for i in r], np.int64)
            texts = [b.decode() for b in model.decode(flat, np.array([len(r) for r in rows], np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, path: str) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding ``text``.

    Null texts count as empty (no ids, digests of nothing); rows with a null
    doc_id and repeated rows are encoded like any other. Other columns are not read.
    """

    def run(batches):
        model = load(path)
        for part, _, ids in _encoded(batches, path, 1):
            n = np.array([len(x) for x in ids], np.int64)
            sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(b).hexdigest() for b in model.decode(np.concatenate(ids), n)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def differences(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose ids or decoded text are not those of the sentencepiece library, batch by batch."""
    at = df.columns.index(text)

    def run(batches):
        import sentencepiece

        model, library = load(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for part, texts, ids in _encoded(batches, path, at):
            want = library.encode(texts, num_threads=1)
            back = model.decode(np.concatenate(ids), np.array([len(x) for x in ids], np.int64))
            wrong = [a.tolist() != b or c.decode() != library.decode(b) for a, b, c in zip(ids, want, back)]
            yield part.filter(pa.array(wrong, pa.bool_()))

    return df.mapInArrow(run, df.schema)
