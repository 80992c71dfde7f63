"""Steps that must not gather what grows with the input in one task, one literal or one batch."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factgrid.functions import fields as fx
from factgrid.operators import aggregates, bm25, index, search
from factgrid.plans import queries
from factgrid.sources import generators


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bounds_are_answered_by_ranges(uncoalesced, monkeypatch):
    """Bounds are no literals, and totals run on from range to range of one place."""
    spark = uncoalesced
    monkeypatch.setattr(aggregates, "interval", lambda *a: pytest.fail("all bounds in one literal"))
    amounts = [Decimal(n * n % 997).scaleb(-1) for n in range(300)]
    text = lambda n, v: f"Order_{n}\nCustomer: Customer_{n % 40:04d}\nAmount: ${v}\nStatus: {'open' if n % 3 else 'paid'}"
    e = spark.createDataFrame([(n, f"Order_{n}", text(n, v)) for n, v in enumerate(amounts)], "pos long, id string, text string").withColumn("fields", fx.field_map("text"))
    bounds = sorted({*amounts[::2], Decimal("0.05"), Decimal("5000"), Decimal("1" + "0" * 34)})
    want = {}
    for b in bounds:
        over, under = [v for v in amounts if v > b], [v for n, v in enumerate(amounts) if v < b and not n % 3]
        want[f"How many records with an amount over ${b} are there?"] = f"{len(over):,}"
        want[f"What is the total paid amount less than ${b}?"] = f"{sum(under):,}" if under else None
        of_name = [v for n, v in enumerate(amounts) if v > b and n % 40 == 7]
        want[f"What is the highest amount over ${b} of Customer_0007?"] = f"{max(of_name):,}" if of_name else None
    for n in range(40):
        want[f"What is the total amount of Customer_{n:04d}?"] = f"{sum(amounts[n::40]):,}"
    got = aggregates.answer_aggregates(e, spark.createDataFrame([(q,) for q in want], "question string")).collect()
    got = {r.question: r.value for r in got}
    assert {q: (v, got.get(q)) for q, v in want.items() if got.get(q) != v} == {} and len(got) == len(want)


def test_scores_of_documents_are_not_moved(spark, monkeypatch):
    """Nothing is joined or grouped by question and document; cells of questions give the same rows as one."""
    d = spark.createDataFrame([(f"d{n}", f"Status of Customer_{n % 7} is open open {'x ' * (n % 5)}ä{n % 3}") for n in range(200)] + [("null", None)], "doc_id string, text string")
    q = spark.createDataFrame([(n, f"status of customer_{n} x x {n % 3}") for n in range(12)] + [(99, "nothing"), (100, None)], "query_id int, text string")
    got = bm25.bm25_top_k(d.repartition(3), q, 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    want = sorted(map(tuple, bm25.Bm25.build(d).top_k(q, 40).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    monkeypatch.setattr(bm25, "CELL", 3)
    assert sorted(map(tuple, bm25.bm25_top_k(d, q, 40).collect())) == want
    assert bm25.bm25_top_k(d, q.limit(0)).count() == 0 == bm25.bm25_top_k(d.limit(0), q).count()


def test_equal_texts_are_compared_once(spark, monkeypatch):
    e = spark.createDataFrame([(n, f"e{n}", None if n % 11 == 3 else f"word{n % 9} and other{n % 4} ") for n in range(150)], "pos long, id string, text string")
    q = e.where("pos % 10 = 0").select(F.col("pos").alias("query_id"), "text")
    want = search.hamming_top_k(search.encode(e), search.encode(q)).select("query_id", "rank", "id", "pos", "distance", "score")
    met, plain = [], search.hamming_top_k
    monkeypatch.setattr(search, "hamming_top_k", lambda a, b, k: (met.append((a.count(), b.count())), plain(a, b, k))[1])
    assert sorted(map(tuple, search.nearest_texts(e, q).collect())) == sorted(map(tuple, want.collect()))
    assert met == [(37, q.select("text").distinct().count())]


def test_rows_without_a_neighbour_are_dealt(uncoalesced):
    spark = uncoalesced
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.createDataFrame([(n, n + 1 if n % 10 == 0 else None) for n in range(1000)], "pos long, near1 long")
    got = generators._beside(rows, spark.range(2000).select(F.col("id").alias("near1"), F.lit("t").alias("other")), "near1")
    parts = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    there = sorted(r.pos for r in got.where("other is not null").collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 1000 and max(parts) < 400 and there == list(range(0, 1000, 10))


def test_bits_are_made_by_few_rows():
    import tracemalloc

    import numpy as np
    import pandas as pd

    v = pd.Series([*np.random.default_rng(5).normal(size=(1500, 64)).astype(np.float32)])
    tracemalloc.start()
    bits = queries._margins(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(bits) == 1500 and bits[700] == queries._margins(v.iloc[700:701])[0]


def test_words_are_counted_where_a_document_is_read(spark, monkeypatch):
    """Postings are made without a shuffle of words, and runs of them are as those that are grouped by document and word."""
    d = spark.createDataFrame([(n, " ".join(f"w{n * k % 13}" for k in range(n % 40)) + " Ä x") for n in range(300)] + [(900, None), (901, ""), (902, "...")], "doc_id long, text string")
    monkeypatch.setattr(bm25, "WORDS_AT_ONCE", 500)
    monkeypatch.setattr(bm25, "RUN", 7)
    made = bm25._runs(d)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and max(len(r.p) for r in made.collect()) == 7
    want = sorted((r.doc_id, r.term, r.tf, r.dl) for r in bm25.postings(d, "doc_id").collect())
    made = bm25.Bm25.build(d)
    got = made.held.collect()
    assert sorted((r.doc_id, r.term, r.tf, r.dl) for r in got) == want and len(want) > 1000 and made.n == 303
    high = made.levels.agg(F.sum("n"), F.max("level")).first()
    assert high[0] == len(want) and {r.level for r in got} == {r.level for r in made.levels.collect()} and high[1] < bm25.LEVELS


def test_layers_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Rows that are alike take few bytes on the way, yet no task gets more than its share of them, and no wide row is ordered to be merged."""
    monkeypatch.setattr(index, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(index, "FEW", 0)
    e = spark.range(6000).select(F.col("id").alias("pos"), F.concat(F.lit("R"), "id").alias("id"), F.lit("old").alias("text"), F.lit(b"x" * 1250).alias("hv"))
    for buckets in (12, 3):
        sizes = [r[1] for r in index._dealt(e, buckets, 6000).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) < 700
    at = f"file://{tmp_path}/ix"
    index.save(e, at)
    for k in (3, 2):
        index.append(e.where(f"pos % {k} = 0").select("pos", "id", F.lit(f"new{k}").alias("text")), at)
    merged = index.load(spark, at)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and "ShuffledHashJoin" in plan
    got = {r.pos: r.text for r in merged.collect()}
    assert len(got) == 6000 == merged.count() and all(t == ("new2" if p % 2 == 0 else "new3" if p % 3 == 0 else "old") for p, t in got.items())
    index.compact(spark, at)
    assert {r.pos: r.text for r in index.load(spark, at).collect()} == got


def test_few_texts_are_made_to_know_that_they_are_many(spark, monkeypatch):
    """Whether texts are few is told without making all of them, and exactly."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    e = spark.range(0, 40_000, 1, 2).select("id", F.repeat(F.lit("x"), 50).alias("q")).mapInArrow(run, "id long, q string")
    assert search._beyond(e, 1 << 10) and made.value < 10_000
    monkeypatch.setattr(search, "_places_held", lambda *a: pytest.fail("many"))
    names = spark.createDataFrame([("xx",)], "name string")
    few = spark.createDataFrame([(1, "axxa"), (2, ""), (3, None), (4, "bb")], "id long, q string")
    few = few.union(spark.range(10, 10 + (search.FEW_LETTERS - 6) // 10, 1, 2).select("id", F.repeat(F.lit("c"), 10)))
    assert [tuple(r) for r in search.holding(few, names, "id").collect()] == [(1, "xx")]
    monkeypatch.setattr(search, "_parts_held", lambda *a: pytest.fail("few"))
    monkeypatch.setattr(search, "_places_held", lambda *a: "many")
    assert search.holding(few.union(spark.createDataFrame([(5, "c")], "id long, q string")), names, "id") == "many"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_of_a_batch_are_made_run_by_run(spark):
    """A worker's arrays follow a short run of texts, not the batch; nulls, empty and long texts, and a part of a batch are read alike."""
    import tracemalloc

    import pyarrow as pa

    from factgrid.functions import windows

    texts = [None, "", "ä" * 5, "x" * 300_000, "", *[f"text {n} of the batch " * 9 for n in range(20_000)], None, ""]
    for column, want in ((pa.array(texts), texts), (pa.array(texts).slice(2, 9), texts[2:11]), (pa.array(texts[:2]), texts[:2]), (pa.array([], pa.string()), [])):
        got = []
        for first, data, starts in windows.runs(column):
            assert first == len(got) and (len(data) <= windows.RUN_BYTES or len(starts) == 2)
            got += [data[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        assert got == [(t or "").encode() for t in want]
    tracemalloc.start()
    for _, data, starts in windows.runs(pa.array(texts[5:])):
        windows.Windows(data, starts).of(8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6


def test_fields_that_come_once_are_read_once(spark):
    """Records of many fields take time by their lines; a later line still wins, in the place of the first."""
    import time

    wide = "Title\n" + "\n".join(f"Field {n}: value: {n}" for n in range(400))
    rows = [(wide,), ("T\nA: 1\nB: 2: 3\nno field\nA: 4\r\n: x\nC: ",), (None,), ("T",)]
    got = [r.f for r in spark.createDataFrame(rows, "text string").select(fx.field_map("text").alias("f")).collect()]
    assert got[0] == {f"Field {n}": f"value: {n}" for n in range(400)} and got[1:] == [{"A": "4", "B": "2: 3", "": "x", "C": ""}, {}, {}]
    many = spark.range(0, 300, 1, 1).select(F.lit(wide).alias("text"), "id").select(F.concat("text", F.lit("\nId: "), "id").alias("text"))
    began = time.time()
    assert many.select(F.sum(F.size(fx.field_map("text")))).first()[0] == 300 * 401
    assert time.time() - began < 8


def test_questions_of_an_order_are_read_from_one_rendering(spark, sf):
    plan = queries.scl08_questions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [o_orderkey") == 1


def test_words_are_looked_for_before_patterns(spark):
    """What is read with words looked for first is what the patterns alone read."""
    from factgrid.functions import questions as qx

    parts = ["total", "sums", "sum of", "how many", "miscount", "owe", "max", "größte", "open tickets", "reopen tickets", "open", "in production", "paid", "unpaid", "über 5", "over $1,0.5", "overdue", "less than ,", "under  7.", "trend up", "us_east", "east", "stocks", "Ä_1", "x A_b1_", "owed", "30-day sales"]
    texts = [None, "", *parts, *[f"{a}{mark}{b.upper()}" for a in parts for b in parts for mark in (" ", "")]]
    t = spark.createDataFrame([(x,) for x in texts], "question string").repartition(2)
    q = F.lower("question")
    first = lambda q, rules: F.coalesce(*[F.when(q.rlike(f"(?U){p}"), F.lit(v)) for p, v in rules])
    plain = F.regexp_replace(q, r"\bopen tickets\b", "tickets")
    want = t.select(
        "question", first(q, qx.AGGREGATE_FIELDS).alias("field"), first(q, qx.LOOKUP_FIELDS).alias("lookup_field"), first(plain, [(rf"\b{s}\b", s) for s in qx.STATUSES]).alias("status"),
        first(q, [(qx.TREND_PLACE.format(w=w), v) for w, v in qx.TRENDS.items()]).alias("trend"), first(q, [(qx.REGION_PLACE.format(r=r), r) for r in qx.REGIONS]).alias("region"),
        F.regexp_extract(q, qx.THRESHOLD, 1).isin(qx.UNDER.split("|")).alias("below"), F.replace(F.regexp_extract(q, qx.THRESHOLD, 2), F.lit(","), F.lit("")).try_cast("decimal(38,2)").alias("bound"),
        F.nullif(F.lower(F.regexp_extract("question", r"\b[A-Za-z]+_[A-Za-z0-9]+\b", 0)), F.lit("")).alias("entity"),
    )
    got = qx.parse(t).withColumn("region", F.lower("region"))
    assert got.select(*want.columns).exceptAll(want).collect() == [] == want.exceptAll(got.select(*want.columns)).collect()
    ops = t.select(qx._first(q, qx.OPERATIONS).alias("a"), first(q, qx.OPERATIONS).alias("b"))
    assert ops.where("not (a <=> b)").count() == 0 < ops.where("a is not null").count()
    assert set(got.columns) == {"question", "operation", "marked", "wants_record", *want.columns}


def test_filter_columns_share_one_field_map(spark):
    e = spark.createDataFrame([(1, "a", "T\nRegion: EU\nStatus: Open"), (2, "b", None)], "pos long, id string, text string")
    got = index.completed(e, ["id", "text", "by_Region", "by_Status"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    assert sorted(map(tuple, got.collect()))[0][1:] == ("a", "T\nRegion: EU\nStatus: Open", "eu", "open") and got.columns == ["pos", "id", "text", "by_Region", "by_Status"]
    assert index.completed(e, ["text", "by_Region", "fields"]).where("fields['Status'] = 'Open' and by_Region = 'eu'").count() == 1


def test_noted_segments_are_found_by_filters_that_have_room(spark, monkeypatch):
    """What is moved does not grow when a filter is full: there are as many as are needed; answers go back packed."""
    import random

    from factgrid.llm import suffix

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [some(24) for _ in range(150)]
    texts = ["".join(x for p in rng.sample(phrases, 12) for x in (some(200), p)) for _ in range(160)]
    texts += [texts[n][100:900] + some(50) for n in range(40)] + [texts[7]] * 3
    d = spark.createDataFrame([*enumerate(texts, -50)], "doc_id long, text string").repartition(3)
    written, plain = [], suffix.stash
    monkeypatch.setattr(suffix, "stash", lambda df: (written.append(plain(df)), written[-1])[1])

    def run(log2):
        written.clear()
        got = sorted(map(tuple, suffix.remove_repeats(d, noted_log2=log2).collect()))
        return got, sum(t.agg(F.sum(F.length("bytes"))).first()[0] or 0 for t in written if "bytes" in t.columns), len(written)

    want, moved, _ = run(22)
    again, small, tables = run(13)
    assert again == want and sum(r[2] for r in want) > 30_000 and tables >= 3
    assert moved <= small < 1.3 * moved < 0.7 * sum(map(len, texts))
    gone = written[0].where("g is not null")
    assert gone.count() < 300 < gone.agg(F.sum(F.length("g") / 5)).first()[0]  # many to a row


def test_queries_beyond_what_is_broadcast_take_rounds(spark, monkeypatch):
    """Vectors of entries are written once and neither moved nor repeated for each tile of queries; the rows are as all distances give them."""
    import numpy as np

    for name, value in (("QUERY_TILE", 16), ("ENTRY_TILE", 64), ("SCAN_BYTES", 2 * 16 * 1350)):
        monkeypatch.setattr(search, name, value)
    plans, plain = [], getattr(search, "put", None)
    monkeypatch.setattr(search, "put", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, path))[1], raising=False)
    texts = [f"old{n % 4} ring brand {n % 5} kind{n % 3} {n // 7}" for n in range(420)]
    e = spark.createDataFrame([(n, f"e{n}", t) for n, t in enumerate(texts)], "pos long, id string, text string")
    found = search.nearest_texts(e, e.where("pos % 3 = 0").select(F.col("pos").alias("query_id"), "text"))
    bits = [np.frombuffer(v, np.uint8) for v in search.bundles(texts)]
    want = []
    for q in range(0, 420, 3):
        d = sorted((int(np.bitwise_count(bits[q] ^ v).sum()), n) for n, v in enumerate(bits))
        want += [(q, r, f"e{n}", n, x, 1 - x / 10_000) for r, (x, n) in enumerate(d[:5], 1)]
    assert sorted(map(tuple, found.collect())) == want
    assert len(plans) >= 4 and not any(x in p for p in plans for x in ("Join", "Generate"))


def test_runs_of_entries_that_are_alike_are_passed_over():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    near = lambda v: np.packbits(np.unpackbits(np.frombuffer(v, np.uint8)) ^ (rng.random(10_000) < 0.09)).tobytes()
    first = [rng.bytes(1250) for _ in range(30)]
    hv, qs = [near(v) for v in first for _ in range(50)], [near(v) for v in first]
    all_d = np.array([[(int.from_bytes(q) ^ int.from_bytes(v)).bit_count() for v in hv] for q in qs])
    bounds = np.sort(all_d, axis=1)[:, 4].tolist()
    pos = rng.permutation(len(hv))
    tile = search._Tile(pa.table({"pos": pos, "id": [str(p) for p in pos], "hv": pa.array(hv, pa.binary())}), 40)
    wide = search._wide(b"".join(qs), len(qs))
    best = search._Best([*range(len(qs))], wide, bounds, 5)
    best.meet(tile)
    want = [(q, p, str(p), d) for q in range(len(qs)) for d, p in sorted(zip(all_d[q].tolist(), pos.tolist()))[:5]]
    assert sorted((q, p, n, d) for q, n, p, d in best.rows()) == sorted((q, p, n, d) for q, p, n, d in want)
    kept = [tile.beside(v, b) for v, b in zip(wide, bounds)]
    assert sum(len(hv) if x is None else len(x) for x in kept) < 0.2 * len(qs) * len(hv)
    assert search._Tile(pa.table({"pos": [1, 2], "id": ["a", "b"], "hv": pa.array([bytes(1250), b"\xff" * 1250])}), 40).heads is None
