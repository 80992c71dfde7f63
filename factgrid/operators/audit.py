"""The audit log: an append-only table whose events are chained by hash."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import commit, content, names

SCHEMA = "id long, ts string, payload string, prev_sha256 string, event_sha256 string"
FIELDS = ("ts", "principal", "policy", "question", "answer_path", "refused", "policy_denied", "blocked_generation", "record_ids", "record_hashes", "answer_sha256", "retrieval_ms", "generation_ms")


class AuditLog:
    """Writers append; anybody may read and verify in parallel.

    The log is a folder of commits. A commit holds one event or a group of
    events in one file, which is named by the number of its first event and
    never removed or replaced. Since a file's name can be taken once only,
    whoever appends to an end that is not the end any more is refused and links
    to the new one: the chain cannot fork, however old a writer's knowledge is.
    A file is complete when it appears, so a crash leaves the group whole or
    out. The canonical payload is stored, so no reader must rebuild it.
    Removal at the tail shows only against an anchored head.

    Linking is sequential by nature and done on the driver; the cost of a write
    is one file, whether it holds one event or thousands (``record_all``).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._head: tuple[int, str] | None = None  # number and hash of the last event known here

    def events(self) -> DataFrame:
        if not names(self.spark, f"{self.path}/commits"):  # nothing was recorded yet
            return self.spark.createDataFrame([], SCHEMA)
        groups = self.spark.read.text(f"{self.path}/commits", wholetext=True)
        return groups.select(F.explode(F.from_json("value", f"array<struct<{SCHEMA}>>")).alias("e")).select("e.*")

    def _read_head(self) -> tuple[int, str]:
        """Number and hash of the last event, from the last commit."""
        found = names(self.spark, f"{self.path}/commits")
        if not found:
            return 0, ""
        row = json.loads(content(self.spark, f"{self.path}/commits/{found[-1]}"))[-1]
        return row["id"], row["event_sha256"]

    def _take(self, *rows: list) -> bool:
        """Commit linked rows, unless the number of the first is taken."""
        keys = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        return commit(self.spark, f"{self.path}/commits", f"{rows[0][0]:019d}", json.dumps([dict(zip(keys, r)) for r in rows]))

    def record(self, event: dict) -> int:
        return self.record_all([event])[0]

    def record_all(self, events: list[dict]) -> list[int]:
        """Append events in their order, as one file; their numbers."""
        if not events:
            return []
        while True:
            n, prev = self._head or self._read_head()
            rows = []
            for k, event in enumerate(events, 1):
                body = {"ts": datetime.now(UTC).isoformat(timespec="milliseconds")} | event
                payload = json.dumps([body.get(f) for f in FIELDS])
                own = hashlib.sha256((payload + prev).encode()).hexdigest()
                rows.append([n + k, body["ts"], payload, prev, own])
                prev = own
            if self._take(*rows):
                self._head = (n + len(rows), prev)
                return [r[0] for r in rows]
            self._head = None  # another writer was first

    def last(self, n: int = 50) -> DataFrame:
        return newest(self.events(), n)

    def verify(self) -> tuple[bool, int | None]:
        bad = broken_links(self.events()).agg(F.min("id")).first()[0]
        return bad is None, bad


def newest(events: DataFrame, n: int = 50, key: str = "id") -> DataFrame:
    """The newest ``n`` events, oldest first."""
    return events.orderBy(F.desc(key)).limit(n).orderBy(key)


def broken_links(events: DataFrame, own: Column | None = None, per_range: int = 1_000_000) -> DataFrame:
    """Events whose own hash, or whose link to the event before, is wrong.

    ``own`` is the hash an event should have (by default that of its payload
    and the hash before). Only the last event of each range of ids needs its
    neighbour in another range: ranges of ``per_range`` ids are checked by
    themselves and their edges joined, so no task sees the whole log.
    """
    own = F.sha2(F.concat("payload", "prev_sha256"), 256) if own is None else own
    e = events.withColumn("run", F.floor(F.col("id") / per_range))
    in_run = Window.partitionBy("run").orderBy("id")
    e = e.withColumn("before", F.lag("event_sha256").over(in_run))
    tails = e.groupBy("run").agg(F.max_by("event_sha256", "id").alias("tail"))
    chain = tails.withColumn("edge", F.lag("tail").over(Window.orderBy("run"))).select("run", "edge")  # one row a range
    e = e.join(chain, "run")
    expected = F.coalesce("before", "edge", F.lit(""))
    return e.where((F.col("prev_sha256") != expected) | (F.col("event_sha256") != own)).select("id")


def changed_records(events: DataFrame, entries: DataFrame) -> DataFrame:
    """``event_id, id``: cited records whose text is no longer the one that was hashed, or that are gone."""
    ids, hashes = (F.from_json(F.get_json_object("payload", f"$[{FIELDS.index(f)}]"), "array<string>") for f in ("record_ids", "record_hashes"))
    cited = events.select(F.col("id").alias("event_id"), F.explode(F.arrays_zip(ids.alias("id"), hashes.alias("h"))).alias("c")).select("event_id", "c.id", "c.h")
    now = entries.select("id", F.sha2("text", 256).alias("now"))
    # an id that several records share is unchanged if one of them is the cited one
    same = cited.join(now, "id", "left").groupBy("event_id", "id", "h").agg(F.max((F.col("now") == F.col("h")).cast("int")).alias("same"))
    return same.where(F.coalesce("same", F.lit(0)) == 0).select("event_id", "id")
