"""Column functions over rendered records (``title`` line, then ``Field: value`` lines) and free text.

Everything here is a Spark expression; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that answers must agree on.
NUMBER = r"-?[\d,]+(?:\.\d+)?"
FIGURE = r"-?\$?\d[\d,]*(?:\.\d+)?"
ID_TOKEN = r"\b[A-Za-z]+_[A-Za-z0-9]+\b|\b[A-Za-z]+(?:-[A-Za-z0-9]*\d[A-Za-z0-9]*)+\b"
COMPANY = (
    r"\b(?:[A-ZÄÖÜ][\w&.\-]*\s+)+?(?:GmbH|AG|SE|KG|Corp\.?|Corporation|Inc\.?|Ltd\.?|LLC|Co\.)\b"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+\s+&\s+[A-ZÄÖÜ][a-zäöüß]+\b"
)
AGGREGATION_MARKERS = (
    "total", "sum of", "average", "mean", "how many", "count of", "combined", "across all",
    "all invoices", "all orders", "all customers", "overall", "insgesamt", "summe", "durchschnitt", "wie viele",
)
LINES = r"\R|[\x1c-\x1e]"


def lines(text) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, LINES)


def field_map(text) -> Column:
    """``MAP<STRING,STRING>`` of the ``Field: value`` lines; a later line wins over an earlier one."""
    def read(p: Column) -> Column:  # p: the lines, evaluated once
        keys = F.transform(p, lambda x: F.substring_index(x, ": ", 1))
        return F.transform(F.array(keys), lambda keys: of(p, keys))[0]

    def of(p: Column, keys: Column) -> Column:
        own = F.array_distinct(keys)
        last = lambda k: F.element_at(F.filter(p, lambda x: F.startswith(x, F.concat(k, F.lit(": ")))), -1)
        again = F.map_from_arrays(own, F.transform(own, lambda k: F.substr(last(k), F.length(k) + 3)))
        # where no key comes twice, each line is read once
        return F.when(F.size(own) == F.size(keys), F.map_from_arrays(keys, F.transform(p, lambda x: F.substr(x, F.instr(x, ": ") + 2)))).otherwise(again)

    pairs = F.filter(lines(text), lambda x: x.contains(": "))
    return F.transform(F.array(F.coalesce(pairs, F.array().cast("array<string>"))), read)[0]


def field(fields: str, name: str) -> Column:
    """A field's value; NULL where the record has no such field."""
    return F.try_element_at(F.col(fields), F.lit(name))


def amount(raw: Column, scale: int = 2) -> Column:
    """The first number in a formatted value as ``decimal(38, scale)``; NULL if there is none."""
    number = F.regexp_extract(F.replace(raw, F.lit("$"), F.lit("")), NUMBER, 0)
    return F.replace(number, F.lit(","), F.lit("")).try_cast(f"decimal(38,{scale})")


def decimals(raw: Column) -> Column:
    """Digits after the point of the first number in a value."""
    number = F.regexp_extract(F.replace(raw, F.lit("$"), F.lit("")), NUMBER, 0)
    return F.length(F.regexp_extract(number, r"\.(\d+)$", 1))


def title(text) -> Column:
    return F.get(lines(text), F.lit(0))


def entity_key(name: Column) -> Column:
    """The first word that is an id (``Customer_0042``, ``INV-2026-0815``), else the whole title."""
    ids = F.filter(F.split(name, r"\s+"), lambda w: w.rlike(f"^(?:{ID_TOKEN})$"))
    return F.coalesce(F.get(ids, F.lit(0)), name)


def id_tokens(text) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(f"(?U){ID_TOKEN}"), F.lit(0))


def company_names(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){COMPANY}"), F.lit(0)), lambda x: F.lower(F.trim(x)))


def redacted(text, hidden: Iterable[str]) -> Column:
    """Lines of hidden fields (any case) removed, with a note of how many."""
    names = sorted({h.lower() for h in hidden})
    text = F.col(text) if isinstance(text, str) else text
    if not names:
        return text
    all_lines = lines(text)
    left = F.filter(all_lines, lambda x: ~(x.contains(": ") & F.lower(F.substring_index(x, ": ", 1)).isin(names)))
    gone = F.size(all_lines) - F.size(left)
    note = F.concat(F.lit("\n("), gone, F.lit(" field(s) redacted by policy)"))
    return F.when(gone > 0, F.concat(F.array_join(left, "\n"), note)).otherwise(text)


def words(text) -> Column:
    """``[a-z0-9]+`` words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring words joined by ``_``."""
    return F.filter(F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b)), lambda x: x.isNotNull())


def figures(text: Column) -> Column:
    """Distinct figures worth checking: at least 100, or with a decimal point; without trailing zeros."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))
    plain = F.transform(raw, lambda x: F.concat(F.when(x.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(x, r"[-$,]", "")))
    kept = F.filter(plain, lambda x: (x.cast("double") >= 100) | x.contains("."))
    short = F.transform(kept, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x))
    return F.array_distinct(F.transform(short, lambda x: F.when(x == "", F.lit("0")).otherwise(x)))


def ungrounded(answer: Column, sources: Column, question: Column) -> Column:
    """Figures of an answer that neither its sources nor its question hold, in string order."""
    return F.sort_array(F.array_except(figures(answer), F.array_union(figures(sources), figures(question))))


def asks_for_aggregate(question: Column) -> Column:
    q = F.lower(question)
    return F.exists(F.array(*[F.lit(m) for m in AGGREGATION_MARKERS]), lambda m: F.contains(q, m))


def with_glossary(text: Column, glossary: Mapping[str, str]) -> Column:
    """Whole generic words, in any case, replaced by the house's words, in the glossary's order."""
    for generic, own in glossary.items():
        quoted = "\\Q" + generic.replace("\\E", "") + "\\E"
        text = F.regexp_replace(text, f"(?iU)\\b{quoted}\\b", own.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def normal_value(value: Column) -> Column:
    """A value as evaluations compare it: lower case, no commas or dollar signs."""
    return F.translate(F.lower(value), ",$", "")
