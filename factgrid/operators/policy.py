"""Row visibility and field redaction, always before anything is measured, scored or shown."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, field_map, redacted
from ..sources.records import AccessPolicy


#: Beginning of the names of columns that hold a field's value for filters.
BY = "by_"


def filter_value(name: str, fields: str = "fields") -> Column:
    """What a condition on a field is compared with: its value in lower case, empty where the record has none."""
    return F.lower(F.coalesce(field(fields, name), F.lit("")))


def quoted(column: str) -> str:
    """A column's name in backticks."""
    return f"`{column.replace('`', '``')}`"


def visible(policy: AccessPolicy, fields: str = "fields", stored: Iterable[str] = ()) -> Column:
    """All conditions hold; values compare in any case, field names do not; a missing field is empty.

    A field with a column of its own among ``stored`` is read from there, so
    that the test reaches the scan and passes over parts of files.
    """
    stored = set(stored)
    value = lambda f: F.col(quoted(BY + f)) if BY + f in stored else filter_value(f, fields)
    tests = [value(f).isin(sorted(v.lower() for v in allowed)) for f, allowed in sorted(policy.visible_where.items())]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_policy(entries: DataFrame, policy: AccessPolicy) -> DataFrame:
    """Visible entries with hidden fields gone from the text, the field map and the tags.

    ``entries`` has ``id, text`` and may have ``fields`` and ``tags``. Rows are
    judged on the whole text; the filter stands below every later step of a plan.
    Columns that hold hidden fields for filters go, too.
    """
    if "fields" not in entries.columns:
        entries = entries.withColumn("fields", field_map("text"))
    if policy.is_unrestricted:
        return entries
    out = entries.where(visible(policy, stored=entries.columns))
    hidden = sorted(h.lower() for h in policy.hidden_fields)
    if not hidden:
        return out
    out = out.select(*[quoted(c) for c in out.columns if not (c.startswith(BY) and c.removeprefix(BY).lower() in hidden)])
    if "tags" in out.columns:
        secret = F.map_values(F.map_filter("fields", lambda k, v: F.lower(k).isin(hidden)))
        out = out.withColumn("tags", F.array_except("tags", secret))
    return out.withColumns({"text": redacted("text", hidden), "fields": F.map_filter("fields", lambda k, v: ~F.lower(k).isin(hidden))})


def denied(policy: AccessPolicy) -> Column:
    """Parsed questions (``functions.questions.parse``) that ask for a hidden field or filter by one."""
    hidden = sorted(h.lower() for h in policy.hidden_fields)
    if not hidden:
        return F.lit(False)
    by_filter = [F.col(c).isNotNull() for c in ("status", "trend", "region") if c in hidden]
    asked = [F.coalesce(F.lower(c).isin(hidden), F.lit(False)) for c in (F.col("field"), F.col("lookup_field"))]
    return reduce(lambda a, b: a | b, by_filter, asked[0] | asked[1])
