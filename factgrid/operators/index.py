"""The record index: upsert, delete, keep-last, entity vocabulary, and the stored index with its versions.

A stored index is a set of layers of Parquet files, cut by a hash of the id
into buckets, and a log of versions. A version lists its layers: base layers,
each with the buckets that still count, and delta layers, whose rows stand for
those of the same place below them. Appending writes one delta layer with the
new rows alone; ``compact`` folds deltas into the buckets they touch and leaves
the files of all other buckets where they are. A version is entered under the
next number, which can be taken once: of two writers that start from the same
version the second is refused and starts again from the first one's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.fields import field_map, id_tokens
from ..storage import call, commit, content, names, remove, stash
from .policy import BY, filter_value, quoted
from .search import encode, sketch, sketch_top_k

VOCABULARY_FIELDS = ("Customer", "Product", "Department", "Contact")


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` of each key, without sorting whole groups."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r"))
    return last.select(key, "r.*").select(*df.columns)


def _latest(delta: DataFrame) -> DataFrame:
    """Rows of a delta with their place ``__d`` in it: of equal ids the last, at the place of the first; rows without an id each."""
    named = F.coalesce("id", F.lit("")) != ""
    rest = [c for c in delta.columns if c not in ("id", "pos")]
    last = delta.where(named).groupBy("id").agg(F.max_by(F.struct("pos", *rest), "pos").alias("r"), F.min("pos").alias("__d"))
    return last.select("id", *[f"r.{c}" for c in rest], "__d").unionByName(delta.where(~named).withColumnRenamed("pos", "__d"))


def completed(rows: DataFrame, columns: list[str], encoding: str = "v1") -> DataFrame:
    """``rows`` with the named columns, in their order: field maps, vectors, sketches and columns for filters are made where they are missing, others are null."""
    made = {"fields": lambda r: r.withColumn("fields", field_map("text")), "hv": lambda r: encode(r, encoding=encoding), "sk": lambda r: r.withColumn("sk", sketch())}
    by = [c for c in columns if c.startswith(BY) and c not in rows.columns]
    lent = bool(by) and "fields" not in rows.columns and "fields" not in columns
    if by:  # a text's field map is made once for all of them
        rows = rows if "fields" in rows.columns else made["fields"](rows)
        rows = rows.withColumns({c: filter_value(c.removeprefix(BY)) for c in by})
    rows = rows.drop("fields") if lent else rows
    for c in columns:
        if c not in rows.columns:
            rows = made[c](rows) if c in made else rows.withColumn(c, F.lit(None))
    return rows


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Replace entries by id and append new ones. Both have ``pos, id, text``; what else ``base`` has is made for new rows.

    A replaced entry keeps its place (of several with its id the last goes);
    of equal ids in ``delta`` the last wins; new ids, and rows without an id,
    follow the greatest place of ``base`` in the order of ``delta``.
    """
    new = completed(_latest(delta), [c for c in base.columns if c != "pos"])
    old = base.groupBy("id").agg(F.max("pos").alias("pos"))
    top = base.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("__top"))
    placed = new.join(old, "id", "left").crossJoin(F.broadcast(top))  # one row
    placed = placed.withColumn("pos", F.coalesce("pos", F.col("__top") + F.col("__d")))
    return base.join(placed.select("pos"), "pos", "left_anti").unionByName(placed.select(*base.columns))


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries whose id is not in ``ids``; unknown ids do nothing, repeated ids all go."""
    return base.join(ids.select("id").distinct(), "id", "left_anti")


def known_entities(entries: DataFrame) -> DataFrame:
    """Distinct lower-case names: values of the vocabulary fields and all id tokens of the texts."""
    e = entries if "fields" in entries.columns else entries.withColumn("fields", field_map("text"))
    values = F.array_compact(F.array(*[F.nullif(F.trim(F.try_element_at("fields", F.lit(f))), F.lit("")) for f in VOCABULARY_FIELDS]))
    return e.select(F.explode(F.array_union(F.transform(values, F.lower), F.transform(id_tokens("text"), F.lower))).alias("name")).distinct()


# -- the stored index ------------------------------------------------------
#: Entries of a bucket, by which the number of buckets of a new index follows its size; delta layers that are read before they are folded.
BUCKET_ENTRIES, DELTAS = 100_000, 8
#: Rows that a join may broadcast the places and ids of.
FEW = 1 << 18


class Conflict(RuntimeError):
    """Another writer has entered a version since the one this writer began from."""


@dataclass
class Version:
    """What the log says of a version; ``number`` 0 is that of no index."""

    number: int
    entry_count: int
    next_pos: int
    buckets: int
    columns: str  # schema of an entry, as JSON
    #: Folder, kind ("base" or "delta"), rows written, buckets that count.
    layers: list[dict]
    dimensions: int = 10_000
    encoding: str = "v1"
    #: The last micro-batch of each stream.
    applied: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.columns))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(names(spark, f"{path}/_log"))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or that of a number."""
    found = names(spark, f"{path}/_log")
    if not found:
        raise ValueError(f"no index at {path}")
    name = found[-1] if number is None else f"{number:010d}"
    return Version(int(name), **json.loads(content(spark, f"{path}/_log/{name}")))


def _enter(spark: SparkSession, path: str, version: Version) -> Version:
    told = {k: v for k, v in vars(version).items() if k != "number"}
    if not commit(spark, f"{path}/_log", f"{version.number:010d}", json.dumps(told)):
        raise Conflict(f"version {version.number} of {path} is another writer's")
    return version


def _bucket(buckets: int) -> Column:
    """By id, so that an upsert reads the buckets of its ids only; rows without one by place."""
    return F.pmod(F.xxhash64(F.coalesce(F.nullif("id", F.lit("")), F.col("pos").cast("string"))), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, buckets: int, most: int) -> DataFrame:
    """``rows`` (``most`` of them at the most) with their bucket, about ``BUCKET_ENTRIES`` to a task.

    Tasks follow the number of rows, not the bytes moved: vectors that are
    alike take few bytes on the way and all of them again where they are ordered.
    """
    tasks = max(1, -(-most // BUCKET_ENTRIES))
    parts = -(-tasks // buckets)  # of a bucket
    task = F.col("bucket") * parts + F.pmod(F.xxhash64("pos"), F.lit(parts)) if parts > 1 else F.col("bucket") % min(tasks, buckets)
    return rows.withColumn("bucket", _bucket(buckets)).repartitionById(max(parts * buckets, 1) if parts > 1 else min(tasks, buckets), task.cast("int"))


def _small(side: DataFrame, rows: int) -> DataFrame:
    """The narrow side of a join: broadcast if it has few rows, else held by key, so that the wide side is never ordered."""
    return side.hint("broadcast" if rows <= FEW else "shuffle_hash")


def _write(rows: DataFrame, path: str, kind: str, buckets: int, most: int) -> dict:
    """Write a layer, large buckets as several files; its entry for the log.

    Rows of a file lie together by their columns for filters, so that the
    bounds of row groups and pages tell which of them a filter needs.
    """
    spark, folder = rows.sparkSession, f"layer-{uuid.uuid4().hex}"
    by = [quoted(c) for c in rows.columns if c.startswith(BY)]
    dealt = _dealt(rows, buckets, most)
    dealt = dealt.sortWithinPartitions("bucket", *by, "pos") if by else dealt
    dealt.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    at = [int(n.removeprefix("bucket=")) for n in names(spark, f"{path}/{folder}") if n.startswith("bucket=")]
    layer = {"folder": folder, "kind": kind, "rows": 0, "buckets": sorted(at)}
    if at:
        layer["rows"] = _read(spark, path, layer, rows.schema).count()  # from the files' footers
    return layer


def _with(schema: StructType, name: str, kind: str) -> StructType:
    return StructType([*schema.fields]).add(name, kind)


def _read(spark: SparkSession, path: str, layer: dict, schema: StructType, only: set[int] | None = None) -> DataFrame:
    """Rows of a layer in the buckets that count (and are in ``only``)."""
    take = [b for b in layer["buckets"] if only is None or b in only]
    schema = _with(schema, "bucket", "integer")
    if not take:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{layer['folder']}").where(F.col("bucket").isin(take))


def _merged(spark: SparkSession, path: str, version: Version, only: set[int] | None = None) -> DataFrame:
    """The entries of a version, without their bucket."""
    schema = version.schema
    used = lambda kind: [x for x in version.layers if x["kind"] == kind and (only is None or only & {*x["buckets"]})]
    parts = [_read(spark, path, x, schema, only) for x in used("base")]
    base = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _with(schema, "bucket", "integer"))
    with_gone = _with(schema, "gone", "boolean")
    deltas = [_read(spark, path, x, with_gone, only).withColumn("__n", F.lit(n)) for n, x in enumerate(used("delta"))]
    if deltas:
        above, n = reduce(DataFrame.unionByName, deltas), sum(x["rows"] for x in used("delta"))
        last = above.select("pos", "__n")
        if len(deltas) > 1:
            last = last.groupBy("pos").agg(F.max("__n").alias("__n"))
            above = above.join(_small(last, n), ["pos", "__n"], "left_semi")
        base = base.join(_small(last.select("pos"), n), "pos", "left_anti").unionByName(above.where(~F.coalesce("gone", F.lit(False))).drop("gone", "__n"))
    return base.select(*[quoted(c) for c in schema.names])


def save(entries: DataFrame, path: str, dimensions: int = 10_000, encoding: str = "v1", buckets: int | None = None, expected: int | None = None, filters: Iterable[str] = (), sketches: bool = False) -> Version:
    """Write all entries (``pos, id, text`` and more) as a new version, beside the old ones.

    The fields in ``filters`` get columns of their own, by which files are
    ordered, so that a policy's conditions on them reach the scan
    (``policy.visible``). ``sketches`` writes those of the vectors beside them,
    for ``nearest``. Later appends keep both.

    With ``expected``, the version that the entries were taken from (0 for
    none), a version that another writer has entered since is not covered up:
    ``Conflict`` is raised.
    """
    spark = entries.sparkSession
    entries = completed(entries, [*entries.columns, *(BY + f for f in filters), *(["hv", "sk"] if sketches else [])], encoding)
    before = current(spark, path) if exists(spark, path) else None
    number = before.number if before else 0
    if expected is not None and expected != number:
        raise Conflict(f"{path} is at version {number}, these entries come from {expected}")
    n = entries.count()
    buckets = buckets or max(1, -(-n // BUCKET_ENTRIES))
    layer = _write(entries, path, "base", buckets, n)
    version = Version(number + 1, layer["rows"], 0, buckets, entries.schema.json(), [layer] if layer["rows"] else [], dimensions, encoding, before.applied if before else {})
    version.next_pos = _merged(spark, path, version).agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).first()[0]
    while True:
        try:
            return _enter(spark, path, version)
        except Conflict:
            if expected is not None:
                remove(spark, f"{path}/{layer['folder']}")
                raise
            version.number = current(spark, path).number + 1  # the last to save stands


def load(spark: SparkSession, path: str, dimensions: int = 10_000, encoding: str = "v1", number: int | None = None) -> DataFrame:
    """The entries of the newest version (or of ``number``); a wrong dimension, encoding or number of rows is an error."""
    version = current(spark, path, number)
    if version.dimensions != dimensions or version.encoding != encoding:
        raise ValueError(f"index of {version.dimensions} dimensions, encoding {version.encoding}")
    for layer in version.layers:
        kept = _read(spark, path, layer, version.schema).count()  # from the files' footers
        if kept != layer["rows"]:
            raise ValueError("the index does not hold the entries it claims")
    return _merged(spark, path, version)


def nearest(path: str, queries: DataFrame, k: int = 5, candidates: int = 50, exact: bool = False) -> DataFrame:
    """``search.sketch_top_k`` of ``queries (query_id, hv)`` over an index saved with ``sketches``.

    First places, ids and sketches of the entries are read (an eighth of their
    vectors), then whole vectors in the buckets of the candidates only; with
    ``exact`` all of them, if an answer is not certain.
    """
    spark = queries.sparkSession
    version = current(spark, path)
    if "sk" not in version.schema.names:
        raise ValueError(f"{path} has been saved without sketches")

    def whole(picked: DataFrame) -> DataFrame:
        touched = {r[0] for r in picked.select(_bucket(version.buckets)).distinct().collect()}  # numbers of buckets
        return _merged(spark, path, version, touched)

    return sketch_top_k(_merged(spark, path, version), queries, k, candidates, bits=version.dimensions, exact=exact, whole=whole)


def _changed(spark: SparkSession, path: str, change, tries: int) -> Version:
    """Enter what ``change(version)`` gives (a layer, or None, and the next version); after a lost race once more from the new version."""
    for left in range(tries - 1, -1, -1):
        version = current(spark, path)
        layer, after = change(version)
        if after is None:
            return version
        try:
            return _enter(spark, path, after)
        except Conflict:
            if layer:
                remove(spark, f"{path}/{layer['folder']}")
            if not left:
                raise
    raise AssertionError


def append(delta: DataFrame, path: str, source: str | None = None, batch: int = 0, tries: int = 5) -> Version:
    """Upsert ``delta (pos, id, text)`` into the stored index by the rules of ``upsert``; only its texts are encoded.

    Of the stored entries only ids and places are read, in the buckets of the
    new ids. Columns that the index has and ``delta`` lacks are made, or null;
    others are left out. With ``source``, a batch that is not later than the
    last one entered for it does nothing: a stream may run a batch again.
    """
    spark = delta.sparkSession
    version = current(spark, path)
    if source is not None and version.applied.get(source, -1) >= batch:
        return version
    schema, encoding = version.schema, version.encoding
    with call(spark):
        rows = completed(_latest(delta), [c for c in schema.names if c != "pos"], encoding)
        rows = stash(rows.select("__d", *[F.col(quoted(f.name)).cast(f.dataType) for f in schema if f.name != "pos"]))
        n = rows.count()  # from the files' footers

        def change(version: Version):
            if source is not None and version.applied.get(source, -1) >= batch:
                return None, None
            touched = {r[0] for r in rows.where("id is not null and id <> ''").select(_bucket_of_id(version.buckets)).distinct().collect()}  # numbers of buckets
            places = _merged(spark, path, version, touched).select("id", "pos").join(rows.select("id").where("id <> ''").distinct(), "id", "left_semi")
            placed = rows.join(_small(places.groupBy("id").agg(F.max("pos").alias("pos")), n), "id", "left")
            placed = placed.withColumn("pos", F.coalesce("pos", F.lit(version.next_pos) + F.col("__d"))).select(*[quoted(c) for c in schema.names], F.lit(False).alias("gone"))
            layer = _write(placed, path, "delta", version.buckets, n)
            applied = version.applied | ({source: batch} if source is not None else {})
            if not layer["rows"]:
                return layer, replace(version, number=version.number + 1, applied=applied) if source is not None else None
            new = _read(spark, path, layer, schema).where(F.col("pos") >= version.next_pos).agg(F.count("*"), F.max("pos")).first()
            return layer, replace(version, number=version.number + 1, layers=[*version.layers, layer], entry_count=version.entry_count + new[0], next_pos=max(version.next_pos, (-1 if new[1] is None else new[1]) + 1), applied=applied)

        after = _changed(spark, path, change, tries)
    if sum(x["kind"] == "delta" for x in after.layers) > DELTAS:
        after = compact(spark, path)
    return after


def _bucket_of_id(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def withdraw(ids: DataFrame, path: str, tries: int = 5) -> Version:
    """Delete all stored entries with one of ``ids (id)``; unknown ids do nothing."""
    spark = ids.sparkSession
    with call(spark):
        asked = stash(ids.select(F.col("id").cast("string").alias("id")).where("id is not null and id <> ''").distinct())

        def change(version: Version):
            touched = {r[0] for r in asked.select(_bucket_of_id(version.buckets)).distinct().collect()}  # numbers of buckets
            hit = stash(_merged(spark, path, version, touched).select("pos", "id").join(asked, "id", "left_semi"))
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in version.schema if f.name not in ("pos", "id")]
            layer = _write(hit.select("pos", "id", *blank, F.lit(True).alias("gone")), path, "delta", version.buckets, hit.count())
            if not layer["rows"]:
                return layer, None
            return layer, replace(version, number=version.number + 1, layers=[*version.layers, layer], entry_count=version.entry_count - layer["rows"])

        return _changed(spark, path, change, tries)


def compact(spark: SparkSession, path: str, tries: int = 5) -> Version:
    """Fold the delta layers into the buckets they touch; files of other buckets stay as they are."""

    def change(version: Version):
        touched = {b for x in version.layers if x["kind"] == "delta" for b in x["buckets"]}
        if not touched:
            return None, None
        layer = _write(_merged(spark, path, version, touched), path, "base", version.buckets, sum(x["rows"] for x in version.layers))
        kept = []
        for x in version.layers:
            left = [b for b in x["buckets"] if b not in touched]
            if x["kind"] == "base" and left:
                kept.append(x if left == x["buckets"] else x | {"buckets": left, "rows": _read(spark, path, x | {"buckets": left}, version.schema).count()})
        return layer, replace(version, number=version.number + 1, layers=[*kept, *([layer] if layer["rows"] else [])])

    return _changed(spark, path, change, tries)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove versions but the newest ``keep``, and the folders that no version reads any more; not beside a running writer."""
    logged = names(spark, f"{path}/_log")
    used = {x["folder"] for n in logged[-keep:] for x in current(spark, path, int(n)).layers}
    gone = [n for n in names(spark, path) if n.startswith("layer-") and n not in used]
    for n in logged[:-keep]:
        remove(spark, f"{path}/_log/{n}")
    for n in gone:
        remove(spark, f"{path}/{n}")
    return gone


def size(entries: DataFrame, bytes_per_entry: int = 1250) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), (F.count("*") * bytes_per_entry).alias("index_bytes"))


def last_turns(turns: DataFrame, n: int = 6, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
