"""Personal data by fixed forms and bootstrapped contexts, in DataFrame operations only.

Base spans come from regular expressions, with places from the lengths of
matches and of the gaps between them. Around every span and every other
identifier-like token stand lexical patterns (words before, before and after).
Base spans seed a graph of patterns and instances: a pattern is as sure as the
share of its instances that are sure, an instance as its surest patterns; after
a few rounds the instances of sure patterns are added as spans of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

# The forms of the kinds, in the order in which kinds are listed.
# \G and the look-behinds only spare the engine starts that cannot match.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like tokens that may prove to be instances of a kind.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z0-9@._%+/-]{6})[A-Za-z@._%+/-]*+[0-9][A-Za-z0-9@._%+/-]*+"
#: Instances a pattern needs, the share of sure ones, and rounds of scoring.
SUPPORT, SURE, ROUNDS = 4, 0.9, 3
#: Characters looked at on each side of a span.
REACH = 48


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(pattern: str, guard: str) -> str:
    """SQL for the array of (b, e, v): start, end and text of all matches.

    Places are running sums of gap and match lengths. They are taken in runs of
    256 matches, so that texts with very many matches stay near linear.
    """
    p, none = _sql(pattern), "CAST(array() AS array<struct<b:int,e:int,v:string>>)"
    parts = f"zip_with(regexp_extract_all(t, {p}, 0), split(t, {p}, -1), (m, g) -> named_struct('m', m, 'gap', length(g)))"
    runs = "transform(sequence(0, (size(q) - 1) div 256), c -> slice(q, c * 256 + 1, 256))"
    sums = "transform(r, h -> aggregate(h, 0, (s, x) -> s + x.gap + coalesce(length(x.m), 0)))"
    heads = f"aggregate({sums}, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at))).out"
    place = f"""aggregate(h, named_struct('at', o, 'out', {none}), (s, x) -> IF(x.m IS NULL, s, named_struct('at', s.at + x.gap + length(x.m),
        'out', array_append(s.out, named_struct('b', s.at + x.gap, 'e', s.at + x.gap + length(x.m), 'v', x.m))))).out"""
    whole = f"transform(transform(array({parts}), q -> {runs}), r -> flatten(zip_with(r, {heads}, (h, o) -> {place})))[0]"
    return f"CASE WHEN {guard} THEN {whole} ELSE {none} END"


_DIGITS = "length(regexp_replace(x.v, '[^0-9]', ''))"
_LUHN = """aggregate(transform(filter(split(reverse(regexp_replace(x.v, '[^0-9]', '')), ''), c -> c <> ''),
    (c, i) -> IF(i % 2 = 0, CAST(c AS int), IF(CAST(c AS int) > 4, CAST(c AS int) * 2 - 9, CAST(c AS int) * 2))), 0, (a, b) -> a + b) % 10 = 0"""
_KEEP = {
    "email": "true",
    "ip": r"x.v rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$'",
    "card": f"CASE WHEN {_DIGITS} BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"{_DIGITS} BETWEEN 9 AND 15",
}
_GUARD = {"email": "contains(t, '@')", "ip": "digit", "card": "digit", "phone": "contains(t, '+')"}


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``found array<struct<b,k,e,v>>``: base spans by start, then kind as listed.

    ``k`` is the kind's place in ``KINDS``; starts and ends are code points, ends
    exclusive; matches that fail their kind's test are dropped without retries.
    """
    t = docs.withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumn("digit", F.expr("t rlike '[0-9]'"))
    for k, (kind, pattern) in enumerate(KINDS.items()):
        t = t.withColumn(kind, F.expr(f"transform(filter({_found(pattern, _GUARD[kind])}, x -> {_KEEP[kind]}), x -> named_struct('b', x.b, 'k', {k}, 'e', x.e, 'v', x.v))"))
    return t.withColumn("found", F.array_sort(F.concat(*KINDS))).drop(*KINDS)


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(names[x["k"]], F.lit(":"), x["b"], F.lit(":"), x["e"])), ",")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of a place: two words before, one before, one on each side."""

    def words(c):
        return F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"[\s\"'=:;,()<>|]+"), lambda w: w != "")

    left, right = words(before), words(after)
    l1, l2, r1 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    glue = F.regexp_extract(before, r"([=:#]?)[\s\"'(<]*$", 1)
    return F.array_compact(
        F.array(F.concat(F.lit("2 "), l2, F.lit(" "), l1, glue), F.concat(F.lit("1 "), l1, glue), F.concat(F.lit("s "), l1, glue, F.lit(" _ "), r1))
    )


def _score(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """``value, k, sure`` of the instances that sure patterns vouch for.

    ``edges`` has (pattern, value), ``seeds`` (value, k). Each round is two
    partial aggregates and two equi-joins; a word before a third of all
    instances is one key of a join that adaptive execution splits.
    """
    total = stash(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT))
    edges = stash(edges.join(total, "pattern"))
    sure = seeds.withColumn("sure", F.lit(1.0))
    for _ in range(rounds):
        votes = edges.join(sure, "value").groupBy("pattern", "k").agg((F.sum("sure") / F.first("n")).alias("p"), F.sum("sure").alias("s"))
        good = votes.where((F.col("p") >= SURE) & (F.col("s") >= SUPPORT))
        new = edges.join(good.select("pattern", "k", "p"), "pattern").groupBy("value").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("k"), F.max("p").alias("sure"))
        sure = stash(new.join(seeds, "value", "left_anti").select("value", "k", "sure").union(seeds.withColumn("sure", F.lit(1.0))))
    return sure.join(seeds.select("value"), "value", "left_anti")


def personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, base counts per kind, ``base_sha256``, ``spans`` and ``version`` of each row.

    ``version`` is a hash of the text. Null texts are empty: no counts and the digest of nothing. ``spans`` holds
    base spans and those added by context, never overlapping a base span. Rows
    with a null doc_id get base spans only; rows that share a doc_id get each
    other's added spans only where their texts are equal. Other columns are not read.
    """
    d = base_spans(docs.select("doc_id", F.col(text).alias("text")))
    token = F.expr(f"filter({_found(TOKEN, 'digit')}, x -> NOT exists(found, f -> f.b < x.e AND x.b < f.e))")
    cut = d.withColumn("token", F.when(F.col("digit"), token))
    near = lambda x: F.struct(
        x["b"].alias("b"),
        x["e"].alias("e"),
        F.xxhash64(F.lower(x["v"])).alias("value"),
        _patterns(F.substring(F.col("t"), F.greatest(x["b"] - REACH, F.lit(0)) + 1, F.least(x["b"], F.lit(REACH))), F.substring(F.col("t"), x["e"] + 1, F.lit(REACH))).alias("patterns"),
    )
    cut = cut.select(
        "doc_id",
        "found",
        F.transform("found", lambda x: F.struct(x["k"].alias("k"), near(x).alias("at"))).alias("seeds"),
        F.transform(F.coalesce("token", F.expr("CAST(array() AS array<struct<b:int,e:int,v:string>>)")), near).alias("others"),
        F.xxhash64("t").alias("version"),
    )
    slim = F.transform("found", lambda x: F.struct(x["b"].alias("b"), x["k"].alias("k"), x["e"].alias("e")))
    cut = stash(cut.select("doc_id", "version", slim.alias("found"), "seeds", "others"))
    seeded = cut.select(F.explode("seeds").alias("s")).select("s.k", "s.at.value", "s.at.patterns")
    loose = cut.where("size(others) > 0").select("doc_id", "version", F.explode("others").alias("o")).select("doc_id", "version", "o.b", "o.e", "o.value", "o.patterns")
    seeds = seeded.groupBy("value").agg(F.min("k").alias("k"))
    edges = seeded.select("value", F.explode("patterns").alias("pattern")).union(loose.select("value", F.explode("patterns").alias("pattern"))).distinct()
    sure = _score(edges, stash(seeds), rounds)
    same_seed = loose.join(sure, "value").where("doc_id is not null")
    added = same_seed.groupBy("doc_id", "version").agg(F.collect_set(F.struct("b", "k", "e")).alias("more"))
    out = cut.select("doc_id", "version", "found").join(added, ["doc_id", "version"], "left")
    count = [F.expr(f"CAST(size(filter(found, x -> x.k = {k})) AS long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("found", F.coalesce("more", F.expr("CAST(array() AS array<struct<b:int,k:int,e:int>>)"))))
    return out.select("doc_id", *count, F.sha2(_text(F.col("found")), 256).alias("base_sha256"), _text(every).alias("spans"), "version")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with every span of ``personal_data`` replaced by ``[KIND]``; null texts stay null.

    Overlapping spans are replaced together, under the kind that starts first.
    Other columns are kept; ``docs`` must have ``doc_id``.
    """
    found = personal_data(docs, text).where("spans <> ''").select("doc_id", F.col("version").alias("__version"), "spans").groupBy("doc_id", "__version").agg(F.first("spans").alias("__spans"))
    parts = F.transform(F.split("__spans", ","), lambda s: F.split(s, ":"))
    spans = F.transform(parts, lambda p: F.struct(p[1].cast("int").alias("b"), p[2].cast("int").alias("e"), F.upper(p[0]).alias("k")))
    versioned = docs.withColumn("__version", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = versioned.join(found, ["doc_id", "__version"], "left").withColumn("__s", spans).withColumn("__t", F.col(text))
    new = F.expr(
        """aggregate(__s, named_struct('at', 0, 'out', ''),
        (a, x) -> IF(x.b < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out),
            named_struct('at', x.e, 'out', concat(a.out, substring(__t, a.at + 1, x.b - a.at), '[', x.k, ']'))),
        a -> concat(a.out, substring(__t, a.at + 1, length(__t))))"""
    )
    return joined.withColumn(text, F.when(F.col("__s").isNotNull() & F.col("__t").isNotNull(), new).otherwise(F.col(text))).select(*docs.columns)
