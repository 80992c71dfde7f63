"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, with the
class prior taken from the labels. A linear classifier over words and word
beginnings is fitted with numpy by minimising the non-negative risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

so that positives hidden in the unlabelled text are not learned as negatives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import chunks, mix, prefix, span_hash, spans
from .common import stash

#: Bounds of the training sample (rows of least hash) and of the features kept.
MAX_POSITIVE = 2048
MAX_UNLABELLED = 8192
MAX_FEATURES = 8192
#: Least evidence for a feature; at 6 chance lifts one of about 2,000 unrelated features.
MIN_GAIN = 6.0
_U = np.uint64
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[128:] = False
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_HEADS = (4, 6)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes with their rows: words and their first four and six bytes."""
    low, row, s, e = spans(data, starts, _OUTSIDE)
    c = prefix(low)
    out, rows = [span_hash(c, s, e)], [row]
    for n in _HEADS:
        long = e - s >= n
        out.append(mix(span_hash(c, s[long], s[long] + n) + _U(n)))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


class _Table:
    """Look-up of feature hashes in a small sorted key set."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = _U((1 << 20) - 1)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[(keys & self.mask).astype(np.int64)] = np.arange(len(keys))
        self.shared = np.zeros(1 << 20, bool)
        low = (keys & self.mask).astype(np.int64)
        seen, n = np.unique(low, return_counts=True)
        self.shared[seen[n > 1]] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a key, and the keys' numbers."""
        low = (h & self.mask).astype(np.int64)
        at = np.flatnonzero(self.slot[low] >= 0)
        got = self.slot[low[at]].astype(np.int64)
        more = self.shared[low[at]]
        if more.any():
            got[more] = np.minimum(np.searchsorted(self.keys, h[at[more]]), len(self.keys) - 1)
        ok = self.keys[got] == h[at]
        return at[ok], got[ok]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _frequencies(sample: DataFrame) -> DataFrame:
    """``feature, p, u``: texts of the sample that hold a feature, positive and unlabelled."""

    def run(batches):
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, starts in chunks(batch.column(0)):
                row, h = _distinct(*features(data, starts)[::-1])
                keys, at = np.unique(h, return_inverse=True)
                p = np.bincount(at, positive[first + row], len(keys)).astype(np.int64)
                n = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p), pa.array(n - p)], names=["feature", "p", "u"])

    parts = sample.select("text", "positive").mapInArrow(run, "feature long, p long, u long")
    return parts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of all rows one after another, the row of each, and the number of rows."""
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def risk(w: np.ndarray, b: float, pos: tuple, unl: tuple, prior: float) -> tuple[float, float, np.ndarray, float]:
    """``(positive part, rest, gradient of the weights, of the bias)`` of the non-negative risk with the logistic loss.

    The risk is prior * E_p[loss(+)] + max(0, rest), rest = E_u[loss(-)] -
    prior * E_p[loss(-)]. Below zero the rest overfits: there the gradient is
    that of -rest, by which a descent brings it back up.
    """
    (ip, rp, n), (iu, ru, m) = pos, unl
    zp, zu = b + np.bincount(rp, w[ip], n), b + np.bincount(ru, w[iu], m)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    n_p, n_u = max(n, 1), max(m, 1)
    part = prior * np.logaddexp(0, -zp).sum() / n_p
    rest = np.logaddexp(0, zu).sum() / n_u - prior * np.logaddexp(0, zp).sum() / n_p
    up, gp = (1.0, prior * (sp - 1) / n_p) if rest >= 0 else (-1.0, np.zeros(n))
    gp, gu = gp - up * prior * sp / n_p, up * su / n_u
    return part, rest, np.bincount(ip, gp[rp], len(w)) + np.bincount(iu, gu[ru], len(w)), gp.sum() + gu.sum()


def fit_nnpu(rows_p: list[np.ndarray], rows_u: list[np.ndarray], n_features: int, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier over present features by the non-negative risk."""
    pos, unl = _flat(rows_p), _flat(rows_u)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    w, b = np.zeros(n_features), math.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        _, _, gw, gb = risk(w, b, pos, unl, prior)
        g = np.append(gw + l2 * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> dict:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); both are the training rows only.

    At most ``max_positive`` confirmed toxic texts and ``max_unlabelled`` texts,
    those of least id hash, are read; the class prior comes from all labels.
    Without a positive label the model predicts the prior for every text.
    """
    count = labels.where("doc_id is not null and toxic is not null").agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    prior = (count.p or 0) / count.n if count.n else 0.0
    empty = {"keys": np.zeros(0, np.uint64), "w": np.zeros(0), "b": -20.0 if not prior else math.log(prior / (1 - prior)) if prior < 1 else 20.0}
    if not count.p:
        return empty
    spread = F.xxhash64("doc_id")
    ids = docs.select("doc_id").where("doc_id is not null")
    toxic = labels.where("toxic = 1").select("doc_id").distinct().join(ids.distinct(), "doc_id", "left_semi")
    toxic = toxic.orderBy(spread, "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("positive"))
    other = ids.distinct().orderBy(spread, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("positive"))
    sample = stash(docs.select("doc_id", "text").join(stash(toxic.union(other)), "doc_id").select("text", "positive"))
    size = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not size.get(1):
        return empty
    n_p, n_u = size[1], max(size.get(0, 0), 1)
    # half the likelihood-ratio statistic of a feature that is more frequent among positives
    p, u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    gain = F.col("p") * F.log(p / u) - (F.col("p") - F.col("u") * n_p / n_u)
    ranked = _frequencies(sample).where(F.col("p") >= 2).withColumn("gain", gain).where((p > u) & (F.col("gain") >= MIN_GAIN))
    keys = np.array([r.feature for r in ranked.orderBy(F.desc("gain"), "feature").limit(max_features).collect()], np.int64).view(np.uint64)
    keys = np.sort(keys)
    if not len(keys):
        return empty

    def rows(batches):
        table = _Table(keys)
        for batch in batches:
            out = []
            for _, data, starts in chunks(batch.column(0)):
                h, row = features(data, starts)
                at, got = table.find(h)
                row, got = _distinct(row[at], got)
                out += [x.tolist() for x in np.split(got, np.searchsorted(row, np.arange(1, len(starts) - 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["positive", "has"])

    got = sample.select("text", "positive").mapInArrow(rows, "positive int, has array<int>").collect()
    has = {k: [np.array(r.has, np.int64) for r in got if r.positive == k] for k in (0, 1)}
    w, b = fit_nnpu(has[1], has[0], len(keys), prior, l2=0.1 / n_p)
    return {"keys": keys, "w": w, "b": b}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out double`` (0 to 1, higher is likelier toxic) to every row; null texts are empty, a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, "double")
    at = kept.index(text)
    keys, w, b = model["keys"], model["w"], model["b"]

    def run(batches):
        table = _Table(keys)
        for batch in batches:
            found = [np.zeros(0)]
            for _, data, starts in chunks(batch.column(at)):
                z = np.full(len(starts) - 1, b)
                if len(keys):
                    h, row = features(data, starts)
                    hit, got = table.find(h)
                    row, got = _distinct(row[hit], got)
                    z += np.bincount(row, w[got], len(z))
                found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) is divisible by 5 are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Rows with a null doc_id are scored (never learned from); labels with a null
    id or value, or without a document, are ignored; repeated labels count as
    often as they stand in the prior. Other columns are not read.
    """
    model = train(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
