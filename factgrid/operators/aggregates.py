"""Exact aggregates over all visible records, for thousands of questions in one scan.

Questions have few conditions in common: a status, a trend, a region, a field's
bound, a name. One scan gives each record the place that it has among these
(its asked-for values, its amount where bounds are asked for, the names it
holds) and adds records of equal places up; these sums are rolled up over the
filters that are asked for. A question with a bound is a row among the amounts
of its field and name, dealt by ranges, whose running totals answer it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import product
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import amount, decimals, field
from ..functions.questions import REGIONS, STATUSES, TRENDS, parse
from ..storage import stash
from .search import with_parts

#: Bounds of a field that are compared one by one; among more, the stretch of so many is found first.
STRETCH = 64
#: How amounts are held.
VALUE = "decimal(38,6)"
#: Names that are looked for one by one in a text as it is read; more are found by ``with_parts``.
FEW_NAMES = 32


def mentions(entity: str, text: str = "text") -> Column:
    """Whether a record holds a name, in any case."""
    return F.contains(F.lower(text), F.lit(entity.lower()))


def beyond(value: Column, bound, below: bool = False) -> Column:
    """Whether an amount lies above a bound, or below it."""
    bound = F.lit(bound)
    return (value < bound) if below else (value > bound)


#: Fields that a question may filter by, and the values it may name.
FILTERS = {"Status": STATUSES, "Trend": sorted({*TRENDS.values()}), "Region": REGIONS}
_NAMES = ["s", "t", "r"]


def _read_once(entries: DataFrame, names: list[str], fields: str) -> DataFrame:
    """What questions look at: the text and filter fields in lower case, and each asked field's amount with its digits."""
    cols = [F.lower("text").alias("__text")] + [F.lower(F.coalesce(field(fields, f), F.lit(""))).alias(f"__{f}") for f in FILTERS]
    for k, name in enumerate(names):
        cols += [amount(field(fields, name), 6).alias(f"__v{k}"), decimals(field(fields, name)).alias(f"__d{k}")]
    return entries.select(*cols)


def filter_text(q) -> str:
    parts = [(k, v) for k, v in (("Status", q.status), ("Trend", q.trend)) if v is not None]
    if q.bound is not None:
        bound = f"{q.bound.normalize():f}"
        parts.append(("_threshold", ("<" if q.below else ">") + bound))
    parts += [(k, v) for k, v in (("Region", q.region), ("entity", q.entity)) if v is not None]
    return ", ".join(f"{k}={v}" for k, v in parts) or "no filter"


def interval(value: Column, bounds: list[Decimal]) -> Column:
    """Where a value lies among sorted bounds: 2j between bounds j-1 and j, 2j+1 on bound j."""
    if not bounds:
        return F.lit(0).cast("long")

    def array(some: list[Decimal]) -> Column:  # folded to one literal, however many
        return F.expr(f"cast(array({', '.join(f'{x:f}BD' for x in some)}) as array<decimal(38,2)>)")

    below = lambda some: F.size(F.filter(some, lambda x: x < value))
    whole = array(bounds)
    lower = below(whole)
    if len(bounds) > STRETCH:
        stretch = F.greatest(below(array(bounds[::STRETCH])) - 1, F.lit(0)) * STRETCH
        lower = stretch + below(F.slice(whole, stretch + 1, F.lit(STRETCH)))
    return F.when(value.isNotNull(), 2 * lower + F.when(F.get(whole, lower) == value, 1).otherwise(0)).cast("long")


_SUMS = ["n", "total", "top", "low", "digits"]
_PLACE = ["entity", "f", *_NAMES]


def _sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"), F.min("low").alias("low"), F.max("digits").alias("digits"))


def _cells(entries: DataFrame, names: list[str], kinds: DataFrame, bounded: set[tuple[int, bool]], entities: DataFrame | None, few: list[str], fields: str) -> DataFrame:
    """``entity, f, s, t, r, below, b`` with ``n, total, top, low, digits``: sums of the records of each place that ``kinds`` ask for, a null filter for all its values.

    ``f`` is a place in ``names``, -1 for records whatever their fields; ``b``
    is the value, where questions with a bound ask for it (``below`` tells on
    which side), else null. Names of records are in ``entities``, or in ``few``.
    """
    read = _read_once(entries, names, fields)
    told = [F.when(F.col(f"__{f}").isin([v.lower() for v in values]), F.col(f"__{f}")).otherwise("").alias(x) for x, (f, values) in zip(_NAMES, FILTERS.items())]
    one = lambda f, v, d: F.struct(F.lit(f).alias("f"), v.cast(VALUE).alias("v"), d.cast("int").alias("d"))
    seen = [one(-1, F.lit(None), F.lit(None))] + [one(k, F.col(f"__v{k}"), F.col(f"__d{k}")) for k in range(len(names))]
    rows = read.select(F.struct(*told, F.array(*seen).alias("seen")).alias("at"), F.col("__text").alias("q"))
    if entities is None:
        held = [F.when(F.contains("q", F.lit(x)), F.lit(x)) for x in few]
        rows = rows.select("at", F.posexplode(F.array(F.lit(None).cast("string"), *held)).alias("k", "part")).where("k = 0 or part is not null")
    else:
        rows = with_parts(rows, entities, "at")
    rows = rows.select("part", *[f"at.{x}" for x in _NAMES], F.explode("at.seen").alias("x")).select("part", *_NAMES, "x.f", "x.v", "x.d").where("f < 0 or v is not null")
    named = F.col("part").isNotNull()
    wanted = [(F.col("f") == f) & (named if of_name else ~named) for f, of_name in sorted(bounded)]
    b = F.when(reduce(or_, wanted), F.col("v")) if wanted else F.lit(None).cast(VALUE)
    value = F.when(F.col("v").isNotNull(), F.struct("v", "d"))
    cells = rows.withColumn("b", b).groupBy("part", "f", "b", *_NAMES).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max(value).alias("top"), F.min(value).alias("low"), F.max("d").alias("digits"))
    if entities is None:
        cells = cells.withColumnRenamed("part", "entity")
    else:  # parts that are no names have only passed the filter; cells without a part are not dealt by it
        cells = stash(cells)
        of_names = cells.where(named).join(entities.select(F.col("name").cast("binary").alias("part"), F.col("name").alias("entity")), "part").drop("part")
        cells = cells.where(~named).withColumn("entity", F.lit(None).cast("string")).drop("part").unionByName(of_names)
    rolled = F.explode(F.array(*[F.struct(*[(F.col(x) if on else F.lit(None).cast("string")).alias(x) for x, on in zip(_NAMES, which)]) for which in product((True, False), repeat=3)])).alias("k")
    rolled = cells.withColumn("named", F.col("entity").isNotNull()).select("entity", "named", "f", "b", rolled, *_SUMS).select("entity", "named", "f", "b", "k.*", *_SUMS)
    same = [rolled[x].eqNullSafe(kinds[x]) for x in ("named", "f", *_NAMES)]
    asked = rolled.join(F.broadcast(kinds), reduce(and_, same)).select(*[rolled[x] for x in _PLACE], "below", F.when(kinds["bounded"], rolled["b"]).alias("b"), *_SUMS)
    return _sums(asked, [*_PLACE, "below", "b"])


def _running(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (question, its place, ``below``, bound ``b``) with the sums of the cells of its place beyond its bound.

    Cells and questions are dealt together by ranges of place and value and
    written; totals run on within each range, and a range that begins inside a
    place carries what the ranges before it have of that place. So no task
    sees a place as a whole, however many values and questions it has.
    """
    key, side = [*_PLACE, "below"], lambda c, most=None: F.when(F.col("below"), c if most is None else F.coalesce(c, most)).otherwise(F.lit(0).cast(VALUE) - c)
    # a bound that no value comes up to stands behind all values, and where greater ones are asked for before them
    most = F.lit("9" * 32 + "." + "9" * 6).cast(VALUE)
    bound = F.col("b").try_cast(VALUE)
    rows = asked.select("question", *key, side(bound, most).alias("o"), F.when(F.col("below") & bound.isNull(), 2).otherwise(0).alias("kind"))
    both = cells.select(*key, side(F.col("b")).alias("o"), F.lit(1).alias("kind"), *_SUMS).unionByName(rows, allowMissingColumns=True)
    dealt = stash(both.repartitionByRange(*key, "o", "kind").withColumn("chunk", F.spark_partition_id()))
    own = _sums(dealt.where("kind = 1"), [*key, "chunk"])
    ranges = dealt.groupBy(*key, "chunk").agg(F.max("kind").alias("any")).drop("any")
    same = [ranges[x].eqNullSafe(own[x]) for x in [*key, "chunk"]]
    own = ranges.join(own, reduce(and_, same), "left").select(*[ranges[x] for x in [*key, "chunk"]], *_SUMS)  # a row a place and range
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*key, "chunk", *_over(before)).where("n is not null").withColumn("kind", F.lit(-1))
    rows = dealt.unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy("chunk", *key).orderBy(F.asc_nulls_first("o"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("question", *_over(w)).where("question is not null")


def _over(w) -> list[Column]:
    return [F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total"), F.max("top").over(w).alias("top"), F.min("low").over(w).alias("low"), F.max("digits").over(w).alias("digits")]


def answer_aggregates(entries: DataFrame, questions: DataFrame, fields: str = "fields") -> DataFrame:
    """``question, operation, field, value, record_count, filters`` of each aggregate question.

    ``entries`` has ``text`` and a field map; ``questions`` has ``question``.
    Numbers are exact decimals; ``avg`` is rounded half up to cents; ``value``
    keeps the largest scale of its inputs, as text with thousands separators,
    and is NULL where nothing is there to compute. Questions that are no
    aggregate, or name an entity that no record holds, have no row. Counts
    without a field count records; with one, the records whose field is a
    number. All questions are answered by one scan of the records; the driver
    sees the asked fields and the kinds of questions (field, filters, side of
    the bound, with a name or without), of which the rules know a fixed number.
    """
    parts = ["operation", "field", "status", "trend", "region", "below", "bound", "entity"]
    asked = stash(parse(questions.select("question").distinct()).where("operation is not null").select("question", *parts))
    told = asked.groupBy("field").agg(F.slice(F.collect_set("entity"), 1, FEW_NAMES + 1).alias("some")).collect()
    names = sorted(r["field"] for r in told if r["field"] is not None)
    few = sorted({x for r in told for x in r.some})
    entities = asked.select(F.col("entity").alias("name")).where("name is not null").distinct() if len(few) > FEW_NAMES else None

    number = F.coalesce(*[F.when(F.col("field") == name, F.lit(k)) for k, name in enumerate(names)], F.lit(-1)) if names else F.lit(-1)
    bounded = F.col("bound").isNotNull()
    rows = asked.select("question", "entity", number.alias("f"), *[F.lower(c).alias(x) for x, c in zip(_NAMES, ("status", "trend", "region"))], F.when(bounded, F.col("below")).alias("below"), F.col("bound").alias("b"))
    kinds = [tuple(r) for r in rows.select(F.col("entity").isNotNull(), "f", *_NAMES, F.col("b").isNotNull(), "below").distinct().collect()]
    there = (True, -1, None, None, None, False, None)  # by it names are known to be held
    kinds = sorted({*kinds, there} if few else {*kinds}, key=repr)
    table = entries.sparkSession.createDataFrame(kinds, "named boolean, f int, s string, t string, r string, bounded boolean, below boolean")
    cells = stash(_cells(entries, names, table, {(k[1], k[0]) for k in kinds if k[5]}, entities, few, fields))  # read several times
    whole, ranged = cells.where("below is null"), cells.where("below is not null")
    plain = rows.where("b is null")
    got = plain.join(whole.drop("below", "b"), reduce(and_, [plain[x].eqNullSafe(whole[x]) for x in _PLACE]), "left").select("question", *_SUMS)
    if any(k[5] for k in kinds):
        got = got.unionByName(_running(ranged, rows.where("b is not null")))
    both = asked.join(got, "question")
    if few:
        there = whole.where("f = -1 and s is null and t is null and r is null and entity is not null").select("entity").distinct()
        known = both.join(there, "entity", "left_semi")
        both = known.unionByName(both.where("entity is null").select(*known.columns))
    flat = both.select("question", *parts, F.coalesce("n", F.lit(0)).alias("n"), "total", F.col("top.v").alias("top"), F.col("top.d").alias("top_digits"), F.col("low.v").alias("low"), F.col("low.d").alias("low_digits"), "digits")
    told = flat.mapInPandas(_told, "question string, operation string, field string, value string, record_count long, filters string")
    return questions.select("question").join(told, "question")


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers as text."""
    for batch in batches:
        batch = batch.astype(object).where(batch.notna(), None)
        rows = [(q.question, q.operation, q.field, _shown(q), int(q.n), filter_text(q)) for q in batch.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["question", "operation", "field", "value", "record_count", "filters"])


def _shown(q) -> str | None:
    if q.operation == "count":
        return f"{int(q.n):,}" if q.field else str(int(q.n))
    if not q.n:
        return None
    if q.operation == "avg":
        return f"{(q.total / int(q.n)).quantize(Decimal('0.01'), rounding=ROUND_HALF_UP):,}"
    value, digits = {"max": (q.top, q.top_digits), "min": (q.low, q.low_digits)}.get(q.operation, (q.total, q.digits))
    return f"{value.quantize(Decimal(1).scaleb(-int(digits))):,}"


def sentence(row) -> str:
    """An aggregate answer as a sentence that names its filter."""
    end = "This is a calculation over the records themselves."
    if row.field is None:
        return f"{row.value} records ({row.filters})\n{end}"
    if row.value is None:
        return f"No {row.field} is given in the records asked for ({row.filters})."
    return f"{row.operation} of {row.field} over {row.record_count} records ({row.filters}): {row.value}\n{end}"


def sentences(answers: DataFrame) -> DataFrame:
    """``question, text, value`` of answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            yield pd.DataFrame([(r.question, sentence(r), r.value) for r in batch.itertuples(index=False)], columns=["question", "text", "value"])

    return answers.mapInPandas(run, "question string, text string, value string")
