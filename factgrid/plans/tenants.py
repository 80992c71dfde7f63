"""A directory for each tenant; nothing is shared, so no filter can be forgotten."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..operators import index
from ..operators.audit import AuditLog
from .engine import Engine, Settings, prepared

SLUG = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")


class Tenants:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, part: str = "") -> str:
        if not SLUG.fullmatch(name):
            raise ValueError(f"not a tenant name: {name!r}")
        return str(PurePosixPath(self.root) / name / part) if "://" not in self.root else f"{self.root}/{name}/{part}"

    def create(self, name: str, entries: DataFrame) -> None:
        """Save the entries with their vectors, which no question makes again."""
        index.save(prepared(entries), self.path(name, "index"))

    def add(self, name: str, entries: DataFrame) -> None:
        """Upsert ``entries (pos, id, text)`` into the tenant's stored index."""
        index.append(entries, self.path(name, "index"))

    def engine(self, name: str, settings: Settings | None = None, **given) -> Engine:
        """The tenant's engine, over its own index and with its own log."""
        return Engine.open(self.spark, self.path(name, "index"), settings=settings, audit=self.audit(name), **given)

    def entries(self, name: str) -> DataFrame:
        return index.load(self.spark, self.path(name, "index"))

    def audit(self, name: str) -> AuditLog:
        return AuditLog(self.spark, self.path(name, "audit"))

    def names(self) -> list[str]:
        """Tenants that have an index, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()) if fs.exists(hadoop) else []
