"""Sources: tables, delimited files, JSON lines, JDBC and workbooks become entries.

An entry is ``id STRING, text STRING, tags ARRAY<STRING>``: the text has one
``column: value`` line per non-empty column.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stash
from .workbooks import sheet_rows


def entries_from_records(records: DataFrame, id_column: str | None = None, text_columns: list[str] | None = None, tag_columns: list[str] | None = None) -> DataFrame:
    """Render each row; NULL and empty values give no line.

    With ``id_column`` its value is the id and the first line of the text;
    without one ids are ``row_<n>`` in the order of the input's partitions.
    Only the named columns are read from the source.
    """
    shown = text_columns or [c for c in records.columns if c != id_column]
    line = [F.when(F.col(f"`{c}`").cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in shown]
    tags = F.array_compact(F.array(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in tag_columns])) if tag_columns else F.lit(None).cast("array<string>")
    if id_column:
        key = F.col(f"`{id_column}`").cast("string")
        return records.select(key.alias("id"), F.concat_ws("\n", key, *line).alias("text"), tags.alias("tags"))
    body = records.select(F.concat_ws("\n", *line).alias("text"), tags.alias("tags"), F.monotonically_increasing_id().alias("__at"))
    return number_rows(body, "__at").select(F.concat(F.lit("row_"), F.col("n")).alias("id"), "text", "tags")


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """Replace ``order`` by ``n`` = 0, 1, …, without a shuffle of the rows.

    ``order`` is a monotonically increasing id: its high bits are the partition
    and its low 33 bits the place there, so only the counts per partition pass
    through a single window. The ids are not the same if they are made twice,
    so the rows are written once.
    """
    df = stash(df)
    part = F.shiftright(order, 33)
    sizes = df.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first"))
    numbered = df.withColumn("__p", part).join(F.broadcast(first), "__p")  # one row per partition
    return numbered.withColumn("n", F.col("__first") + F.col(order).bitwiseAND((1 << 33) - 1)).drop("__p", "__first", order)


#: Lines, and letters of each, that the delimiter is found from.
SAMPLE_LINES, SAMPLE_LETTERS = 50, 1 << 16


def sniff_delimiter(head: str, cut: bool = False) -> str:
    """The one of ``, ; tab |`` that gives most rows of the sample as many cells as its header; a comma if none divides it.

    Quoted cells are read whole, so what stands inside them divides nothing. Of
    equally good ones that with more cells is taken, then the first listed.
    ``cut`` tells that the sample may end inside a row, which is left out.
    """
    best, found = (0.0, 0), ","
    for mark in ",;\t|":
        rows = [r for r in csv.reader(io.StringIO(head.lstrip("\ufeff"), newline=""), delimiter=mark) if any(c.strip() for c in r)]
        rows = rows[:-1] if cut and len(rows) > 1 else rows
        width = len(rows[0]) if rows else 0
        if width > 1 and (how := (sum(len(r) == width for r in rows) / len(rows), width)) > best:
            best, found = how, mark
    return found


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, **render) -> DataFrame:
    """Entries of a delimited file with a header; all values are text, the delimiter is found if not given."""
    if delimiter is None:
        head = [r.v for r in spark.read.text(path).select(F.substring("value", 1, SAMPLE_LETTERS).alias("v")).limit(SAMPLE_LINES).collect()]
        delimiter = sniff_delimiter("\n".join(head), len(head) == SAMPLE_LINES)
    table = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, inferSchema=False, encoding="UTF-8", escape='"')
    return entries_from_records(table.toDF(*[c.lstrip("\ufeff") for c in table.columns]), **render)


def _line_entry(line: str, n: int) -> tuple[str, str, list[str] | None, str | None]:
    row = json.loads(line)
    if "text" in row:
        meta = row.get("metadata") or {}
        return str(row.get("id", f"row_{n}")), str(row["text"]), meta.get("tags"), json.dumps(meta, ensure_ascii=False)
    body = "\n".join(f"{k}: {v}" for k, v in row.items() if v is not None and str(v) != "")
    return str(row.get("id", f"row_{n}")), body, None, None


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines: those with ``text`` pass through, others are rendered in their key order.

    Blank lines give no entry but count in ``row_<n>``. Key order is part of
    the text, which is why lines are parsed in an Arrow batch and not by schema.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__at"))
    numbered = number_rows(raw, "__at").where(F.trim("value") != "")

    def parse(batches):
        for pdf in batches:
            got = [_line_entry(v, n) for v, n in zip(pdf["value"], pdf["n"])]
            pdf = pdf.iloc[:, :0].copy()
            for k, name in enumerate(("id", "text", "tags", "metadata")):
                pdf[name] = [g[k] for g in got]
            yield pdf

    return numbered.select("value", "n").mapInPandas(parse, "id string, text string, tags array<string>, metadata string")


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, **render) -> DataFrame:
    """Entries of a query run by a database; the driver jar is the cluster's."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return entries_from_records(reader.options(**(properties or {})).load(), **render)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, **render) -> DataFrame:
    """Entries of the rows of a workbook's sheet (by default the one it opens with; its first row is the header), or of a folder of workbooks."""
    return entries_from_records(sheet_rows(spark, path, sheet), **render)


def retrieval_format(records: DataFrame) -> DataFrame:
    """``id, text, tags`` of ``title, content, tags``: the title is the id and the text's first line."""
    return records.select(F.col("title").alias("id"), F.concat_ws("\n", "title", "content").alias("text"), "tags")


def training_format(records: DataFrame, question: str) -> DataFrame:
    """``instruction, input, output`` of ``title, content``; ``{title}`` in ``question`` becomes the title."""
    return records.select(F.replace(F.lit(question), F.lit("{title}"), F.col("title")).alias("instruction"), F.lit("").alias("input"), F.col("content").alias("output"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A frozen question set: ``question, answerable, reason``."""
    return spark.read.schema("question string, answerable boolean, reason string").json(path)


def read_glossary(spark: SparkSession, path: str) -> dict[str, str]:
    """Generic words (lower case) and the house's words for them, in the file's order; an empty file is an error."""
    rows = spark.read.csv(path, header=True).select("generic", "company").where("trim(generic) <> '' and trim(company) <> ''").collect()
    if not rows:
        raise ValueError(f"no terms in {path}")
    return {r.generic.strip().lower(): r.company.strip() for r in rows}


@dataclass(frozen=True)
class AccessPolicy:
    """Which records a principal sees (field → allowed values, all must hold) and which fields are hidden."""

    name: str = "unrestricted"
    visible_where: dict[str, frozenset[str]] = field(default_factory=dict)
    hidden_fields: frozenset[str] = frozenset()

    @property
    def is_unrestricted(self) -> bool:
        return not self.visible_where and not self.hidden_fields

    @classmethod
    def load(cls, path: str) -> AccessPolicy:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        where = {k: frozenset(map(str, v)) for k, v in (spec.get("visible_where") or {}).items()}
        return cls(spec.get("name", "unnamed"), where, frozenset(spec.get("hidden_fields") or ()))
