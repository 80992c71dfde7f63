"""Record operators on small hand-computed fixtures."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgrid.functions import fields as fx
from factgrid.functions import prompts
from factgrid.functions import questions as qx
from factgrid.operators import aggregates, audit, index, metrics, policy, search, verified
from factgrid.plans.engine import Engine, Settings
from factgrid.plans.tenants import Tenants
from factgrid.sources import generators, records
from factgrid.sources.records import AccessPolicy

ROWS = [
    (0, "INV-1", "Invoice Customer_0001\nCustomer: Customer_0001\nAmount: $100.00\nStatus: open\nRegion: EU"),
    (1, "INV-2", "Invoice Customer_0002\nCustomer: Customer_0002\nAmount: $250.50\nStatus: open\nRegion: EU"),
    (2, "INV-3", "Invoice Customer_0003\nCustomer: Customer_0003\nAmount: $49.50\nStatus: paid\nRegion: US"),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ROWS, "pos long, id string, text string").withColumn("fields", fx.field_map("text")).cache()


def ask(spark, entries, *questions):
    q = spark.createDataFrame([(x,) for x in questions], "question string")
    return {r.question: r for r in aggregates.answer_aggregates(entries, q).collect()}


def test_aggregates(spark, entries):
    a, b, c, d, e, f = (
        "What is the total amount of all open invoices?", "What is the average amount?", "How many records are open?",
        "What is the total amount of Customer_0001?", "How many invoices worth more than $200 are there?", "Are there any overdue records?",
    )
    got = ask(spark, entries, a, b, c, d, e, f)
    assert (got[a].value, got[a].record_count) == ("350.50", 2)
    assert got[b].value == "133.33"
    assert got[c].value == "2"
    assert got[d].value == "100.00"
    assert got[e].value == "1"
    assert got[f].value == "0"
    assert aggregates.sentence(got[a]).startswith("sum of Amount over 2 records (Status=open): 350.50")


def test_intervals(spark):
    from decimal import Decimal

    bounds = sorted({Decimal(n * n % 977).scaleb(-1) for n in range(300)})
    values = [Decimal(n).scaleb(-2) for n in range(-50, 10_000, 7)] + bounds[::5] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(38,6)")
    for some in (bounds, bounds[:64], bounds[:65], bounds[:3], bounds[:1]):
        got = df.select("v", aggregates.interval(F.col("v"), some).alias("b")).collect()
        assert all(r.b == (None if r.v is None else sum(x < r.v for x in some) + sum(x <= r.v for x in some)) for r in got)


def test_questions_of_all_kinds_against_brute_force(spark, monkeypatch):
    """Every filter with every operation and bound, one at a time and together."""
    e = generators.business_records(spark, 400, customers=20).withColumn("fields", fx.field_map("text")).cache()
    rows = [(r.text.lower(), {k: v for k, v in r.fields.items()}) for r in e.collect()]
    number = lambda v: (m := __import__("re").search(r"-?[\d,]*\d[\d,]*(?:\.\d+)?", (v or "").replace("$", ""))) and float(m[0].replace(",", ""))
    asked = {}
    for word, op in (("total", "sum"), ("average", "avg"), ("highest", "max"), ("lowest", "min"), ("how many records with an", "n")):
        for status in ("", "open", "paid"):
            for region in ("", "north", "eu"):
                for name in ("", "Customer_0003"):
                    for bound, test in (("", None), (" over $20,000", lambda v: v > 20000), (" under $9,000.50", lambda v: v < 9000.5)):
                        if name and op == "n":
                            continue  # a lookup
                        q = f"What is the {word} {status} amount{bound} in {region} of {name}?".replace("  ", " ").replace(" in of", " of").replace(" of ?", "?").replace(" in ?", "?")
                        hit = [v for t, f in rows if (not status or f.get("Status") == status) and (not region or f.get("Region", "").lower() == region) and name.lower() in t and (v := number(f.get("Amount"))) is not None and (not test or test(v))]
                        asked[q] = (op, len(hit), {"sum": sum, "avg": lambda h: sum(h) / len(h), "max": max, "min": min, "n": len}[op](hit) if hit or op == "n" else None)
    got = ask(spark, e, *asked)
    assert set(got) == set(asked) and len(asked) > 150
    monkeypatch.setattr(aggregates, "FEW_NAMES", 0)  # names by filtered places give the same
    assert ask(spark, e, *asked) == got
    for q, (op, n, value) in asked.items():
        assert got[q].record_count == n, q
        assert (got[q].value is None) == (value is None) and (value is None or abs(float(got[q].value.replace(",", "")) - value) < 0.0051), q


def test_what_is_no_aggregate(spark, entries):
    for q in ("What is the total amount of Customer_9999?", "How many units of Product_0001 are in stock?", "How many records over 500 are there?", "Who is it?", ""):
        assert ask(spark, entries, q) == {}
    nothing = ask(spark, entries, "What is the highest stock?")["What is the highest stock?"]
    assert nothing.value is None and nothing.record_count == 0


def test_open_tickets_is_a_field(spark):
    q = spark.createDataFrame([("any customers with more than 5 open tickets, how many?",), ("what is the sum over , amounts",)], "question string")
    first, second = qx.parse(q).orderBy(F.desc("question")).collect()
    assert second.status is None and second.field == "Open Tickets" and second.bound == 5
    assert first.bound is None  # a lone comma is no bound


def test_fields_last_key_wins_and_odd_texts(spark):
    df = spark.createDataFrame([("a: 1\nb\na: 2: 3\r\nc: x",), ("",), (None,)], "text string").select(fx.field_map("text").alias("f"))
    assert [r.f for r in df.collect()] == [{"a": "2: 3", "c": "x"}, {}, {}]


def test_amount(spark):
    got = spark.createDataFrame([("$1,234.50",), ("-3",), (",",), ("none",), (None,)], "v string").select(fx.amount(F.col("v")).cast("string").alias("a")).collect()
    assert [r.a for r in got] == ["1234.50", "-3.00", None, None, None]


def test_policy_filters_before_anything(spark, entries):
    p = AccessPolicy("eu", {"Region": frozenset({"eu"})}, frozenset({"AMOUNT"}))
    seen = policy.apply_policy(entries.withColumn("tags", F.array(F.lit("$100.00"), F.lit("x"))), p)
    rows = seen.orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1]
    assert "Amount" not in rows[0].text and rows[0].text.endswith("(1 field(s) redacted by policy)")
    assert rows[0].tags == ["x"] and "Amount" not in rows[0].fields
    plan = search.encode(policy.apply_policy(entries, p))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # the filter stands below


def test_grounding(spark):
    df = spark.createDataFrame([("It is $13,897.08, not $12,400.00 or -500.", "Amount: $12,400.00", "")], "a string, s string, q string")
    assert df.select(fx.ungrounded(F.col("a"), F.col("s"), F.col("q")).alias("u")).first().u == ["13897.08"]


def test_hypervectors(spark):
    packed = search.bundle("Invoice ACME Corp amount 12400")
    assert len(packed) == 1250
    assert np.unpackbits(np.frombuffer(packed, np.uint8)).sum() == 5012
    assert hashlib.sha256(packed).hexdigest() == "3be5228c8de7ccbd98b0e0154a0285e72ee1fd32ad51c41af2d37321ce73d6f3"
    assert search.bundle("") == bytes(1250) == search.bundle(None)
    assert search.bundle("open invoices", "v2") != search.bundle("open invoices")


def test_search_order_ties_and_k(spark, entries):
    e = search.encode(entries)
    q = search.encode(spark.createDataFrame([(7, ROWS[1][2])], "query_id long, text string"))
    got = search.hamming_top_k(e, q, 10).orderBy("rank").collect()
    assert got[0].id == "INV-2" and got[0].score == 1.0 and len(got) == 3
    same = e.where("pos = 1").select(F.explode(F.expr("array(5L, 3L, 4L)")).alias("pos"), "id", "hv")
    assert [r.pos for r in search.hamming_top_k(same, q, 2).orderBy("rank").collect()] == [3, 4]
    assert search.hamming_top_k(e.limit(0), q).count() == 0


def test_search_tiles_against_brute_force(spark, monkeypatch):
    """Small tiles, rows given up early, and queries beyond what is broadcast give the same as all distances."""
    rng = np.random.default_rng(1)
    base = rng.bytes(40)

    def near():
        b = bytearray(base)
        for _ in range(rng.integers(0, 30)):
            b[rng.integers(0, 40)] ^= 1 << int(rng.integers(0, 8))
        return bytes(b)

    rows = [(int(p), f"n{p % 50}", near() if p % 3 else rng.bytes(40)) for p in rng.permutation(600)]
    asked = [(f"q{i}", near() if i % 2 else rng.bytes(40)) for i in range(50)]
    want = []
    for i, v in asked:
        d = sorted((sum((a ^ b).bit_count() for a, b in zip(v, w)), p, n) for p, n, w in rows)
        want += [(i, r, n, p, x) for r, (x, p, n) in enumerate(d[:5], 1)]
    e = spark.createDataFrame([*rows, (9999, "x", None)], "pos long, id string, hv binary").repartition(3)
    q = spark.createDataFrame([*asked, ("none", None)], "query_id string, hv binary")
    for given in ({}, {"ENTRY_TILE": 100, "QUERY_TILE": 16, "SEGMENT": 1}, {"SEGMENT": 2, "SCAN_BYTES": 10, "HELD_TILES": 2}):
        for name, value in given.items():
            monkeypatch.setattr(search, name, value)
        found = search.hamming_top_k(e, q, 5, bits=320)
        assert ("slot" in found._jdf.queryExecution().optimizedPlan().toString()) == (search.SCAN_BYTES <= 10)  # the grid
        assert sorted((r.query_id, r["rank"], r.id, r.pos, r.distance) for r in found.collect()) == sorted(want)
    assert search.hamming_top_k(e, q.limit(0)).count() == 0


def test_stored_postings_give_what_all_postings_give(spark, tmp_path, monkeypatch):
    import random

    from factgrid.operators import bm25

    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(500)] + [(900, None), (901, ""), (902, docs_text := text(30)), (903, docs_text)]
    asked = [(i, text(rng.randint(1, 8))) for i in range(40)] + [(90, "nowhere"), (91, None), (92, "c0 c0 c1"), (93, "r1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = key(bm25.bm25_top_k(d, q))
    path = f"file://{tmp_path}/postings"
    made = bm25.Bm25.build(d, path=path)
    assert key(made.top_k(q)) == want == key(bm25.Bm25.open(spark, path).top_k(q))
    monkeypatch.setattr(bm25, "FIRST_SCORED", 40)
    monkeypatch.setattr(bm25, "WHOLE_FIRST", 1)
    monkeypatch.setattr(bm25, "TOLD_TERMS", 3)
    assert key(made.top_k(q)) == want
    work = made.work(q).first()
    assert work.first + work.found + work.completed < work.postings  # some are passed over
    assert made.top_k(q.limit(0)).count() == 0 == bm25.Bm25.build(d.limit(0)).top_k(q).count()
    with pytest.raises(Exception):
        bm25.Bm25.build(d, path=path)


def test_names_are_found_anywhere(spark, monkeypatch):
    import random

    rng = random.Random(1)
    some = ["a", "b", "é", "日", "ab", "cust_", "00"]
    texts = [(i, "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(999, None), (998, "")]
    names = ["".join(rng.choice(some) for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["a", "é", None, "", "x" * 40]
    t, n = spark.createDataFrame(texts, "k long, q string").repartition(3), spark.createDataFrame([(x,) for x in names], "name string")
    want = sorted({(k, m) for k, q in texts for m in names if m and q and m in q})
    for few in (1 << 20, 0):
        monkeypatch.setattr(search, "FEW_LETTERS", few)
        assert sorted(map(tuple, search.holding(t, n, "k").collect())) == want
        assert search.holding(t, n.limit(0), "k").count() == 0 == search.holding(t.limit(0), n, "k").count()
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 1200 + "acme_000123 " + "sit amet " * 900)], "k long, q string")
    vocabulary = spark.range(3000).select(F.concat(F.lit("acme_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name")).union(spark.createDataFrame([(f"{'z' * k}",) for k in range(4, 34)], "name string"))
    moved = []
    join = type(long).join
    monkeypatch.setattr(type(long), "join", lambda self, other, *a: (moved.append(self), join(self, other, *a))[1])
    assert [tuple(r) for r in search.holding(long, vocabulary, "k").collect()] == [(1, "acme_000123")]
    assert moved[0].count() < 100  # of 29,000 places and 31 lengths


def test_upsert_delete(spark):
    base = spark.createDataFrame([(0, "A", "a"), (1, "B", "b")], "pos long, id string, text string")
    delta = spark.createDataFrame([(0, "C", "c"), (1, "A", "a1"), (2, "A", "a2"), (3, "C", "c2")], "pos long, id string, text string")
    got = {r.id: (r.pos, r.text) for r in index.upsert(base, delta).collect()}
    assert got["A"] == (0, "a2") and got["B"] == (1, "b") and got["C"][1] == "c2" and got["C"][0] > 1
    assert [r.id for r in index.delete(base, spark.createDataFrame([("A",), ("Z",)], "id string")).collect()] == ["B"]


def test_save_load(spark, tmp_path, entries):
    path = f"file://{tmp_path}/ix"
    index.save(entries, path)
    assert index.load(spark, path).count() == 3
    with pytest.raises(ValueError):
        index.load(spark, path, dimensions=64)
    with pytest.raises(ValueError):
        index.load(spark, path, encoding="v2")


def test_engine_and_audit(spark, tmp_path, entries):
    log = audit.AuditLog(spark, f"file://{tmp_path}/log")
    engine = Engine(entries, Settings(min_score=0.3), log, generator=lambda p: "It is 999.99")
    total = engine.query("What is the total amount of all open invoices?", principal="ann")
    assert total.path == "computed" and total.values == ["350.50"]
    look = engine.query("What is the status of Customer_0003?")
    assert look.path == "field" and look.values == ["paid"] and look.sources == ["INV-3"]
    assert engine.query("What is the status of Customer_0099?").refused
    secret = AccessPolicy("p", {}, frozenset({"Amount"}))
    assert engine.query("What is the amount of Customer_0003?", secret).policy_denied
    assert log.verify() == (True, None) and audit.changed_records(log.events(), entries).count() == 0
    edited = entries.withColumn("text", F.when(F.col("id") == "INV-3", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert [(r.event_id, r.id) for r in audit.changed_records(log.events(), edited).collect()] == [(2, "INV-3")]
    assert [(r.event_id, r.id) for r in audit.changed_records(log.events(), entries.where("id <> 'INV-3'")).collect()] == [(2, "INV-3")]
    engine.settings.mode = "styled"
    assert engine.query("What is the status of Customer_0003?").blocked_generation == "It is 999.99"
    assert log.verify() == (True, None) and log.events().count() == 5
    other = audit.AuditLog(spark, f"file://{tmp_path}/log")  # two writers: neither forks the chain
    assert (other.record({"question": "a"}), log.record({"question": "b"}), other.record({"question": "c"})) == (6, 7, 8)
    assert log.verify() == (True, None) and log.events().count() == 8
    log._take([9, "t", "lost", log.events().where("id = 8").first().event_sha256, hashlib.sha256(("lost" + log.events().where("id = 8").first().event_sha256).encode()).hexdigest()])
    assert audit.AuditLog(spark, f"file://{tmp_path}/log").record({"question": "d"}) == 10  # a row lost in a crash is written by the next writer
    assert log.verify() == (True, None) and log.events().count() == 10
    assert [r.id for r in log.last(2).collect()] == [9, 10]
    bad = log.events().withColumn("payload", F.when(F.col("id") == 2, "edited").otherwise(F.col("payload")))
    assert [r.id for r in audit.broken_links(bad).collect()] == [2]
    for n in (1, 2, 3, 1000):
        assert [r.id for r in audit.broken_links(log.events().where("id <> 3"), per_range=n).collect()] == [4]
        assert [r.id for r in audit.broken_links(log.events().where("id not between 3 and 7"), per_range=n).collect()] == [8]


def test_generative_answers_fall_back(spark, entries):
    said = ["Invoice 3 has 49.50 and is paid.", "It is 777.77."]
    engine = Engine(entries, Settings(min_score=0.0, mode="generative"), generator=lambda p: said[0] if "49.50" in p and "RECORDS" in p else "")
    good = engine.query("What is the status of Customer_0003?")
    assert (good.path, good.text, good.blocked_generation) == ("generative", said[0], None) and "INV-3" in good.sources
    engine.generator = lambda p: said[1]
    bad = engine.query("What is the status of Customer_0003?")
    assert (bad.path, bad.values, bad.blocked_generation) == ("field", ["paid"], said[1])
    assert engine.query("What is the total amount of all open invoices?").path == "computed"


def test_names_and_leaks(spark, entries):
    names = spark.createDataFrame([(1, "customer_0001"), (2, "eu"), (2, "inv-3"), (3, "nobody")], "query_id long, name string")
    few = sorted((r.query_id, r["rank"], r.id) for r in verified.scan_for(entries, names).collect())
    try:
        verified.FEW, kept = 0, verified.FEW
        assert sorted((r.query_id, r["rank"], r.id) for r in verified.scan_for(entries, names).collect()) == few
    finally:
        verified.FEW = kept
    assert few == [(1, 1, "INV-1"), (2, 1, "INV-1"), (2, 2, "INV-2"), (2, 3, "INV-3")]
    out = entries.select(F.col("pos").alias("query_id"), "text")
    secret = spark.createDataFrame([("CUSTOMER_0002",), ("paid",), ("",), ("zzz",)], "value string")
    assert sorted((r.query_id, r.value) for r in metrics.leaks(out, secret).collect()) == [(1, "CUSTOMER_0002"), (2, "paid")]


@pytest.mark.parametrize("n", [1, 2, 3, 20, 21, 100])
def test_latency(spark, n):
    v = [(x * 7919) % 101 / 4 for x in range(n)]
    got = metrics.latency(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(3), "v").first()
    assert (got.median, got.p95, got.n) == (float(np.median(v)), sorted(v)[int(0.95 * (n - 1))], n) and abs(got["mean"] - np.mean(v)) < 1e-9
    assert metrics.latency(spark.createDataFrame([], "v double"), "v").count() == 0


def test_tenants(spark, tmp_path, entries):
    t = Tenants(spark, f"file://{tmp_path}/tenants")
    t.create("one", entries.select("pos", "id", "text"))
    assert t.names() == ["one"] and t.entries("one").count() == 3 and "hv" in t.entries("one").columns
    assert t.engine("one", Settings(min_score=0.0)).query("What is the status of Customer_0002?").values == ["open"]
    assert t.audit("one").events().count() == 1
    for name in ("../x", "A", ""):
        with pytest.raises(ValueError):
            t.path(name)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿invoice_id;customer;amount\n1;ACME;5\n2;;7\n", encoding="utf-8")
    got = records.read_csv(spark, f"file://{tmp_path}/a.csv", id_column="invoice_id", tag_columns=["customer"]).orderBy("id").collect()
    assert [(r.id, r.text, r.tags) for r in got] == [("1", "1\ncustomer: ACME\namount: 5", ["ACME"]), ("2", "2\namount: 7", [])]
    lines = [json.dumps({"id": "x", "text": "T", "metadata": {"tags": ["a"]}}), "", json.dumps({"z": 1, "a": None, "b": "q"})]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    got = records.read_jsonl(spark, f"file://{tmp_path}/b.jsonl").collect()
    assert [(r.id, r.text, r.tags) for r in got] == [("x", "T", ["a"]), ("row_2", "z: 1\nb: q", None)]
    (tmp_path / "g.csv").write_text("generic,company\nInvoice,Bill\n")
    assert records.read_glossary(spark, f"file://{tmp_path}/g.csv") == {"invoice": "Bill"}
    (tmp_path / "p.json").write_text('{"visible_where": {"Region": ["EU"]}}')
    assert AccessPolicy.load(str(tmp_path / "p.json")).name == "unnamed"


def test_generators(spark, tmp_path):
    one = generators.business_records(spark, 300).orderBy("pos").collect()
    two = generators.business_records(spark, 300).repartition(7).orderBy("pos").collect()
    assert one == two and len({r.tags[0] for r in one}) == 6
    df = generators.business_records(spark, 300).withColumn("fields", fx.field_map("text"))
    seen = set()
    for r in df.collect():
        f, kind = r.fields, r.tags[0]
        seen |= set(f)
        number = lambda k: float(f[k].replace("$", "").replace(",", "").split(" ")[0].rstrip("%"))  # noqa: B023, E731
        assert r.text.startswith(r.id + "\n")
        if kind == "order":
            assert abs(number("Quantity") * number("Unit Price") - number("Total")) < 0.005
        if kind == "budget":
            assert abs(max(0, number("Allocated") - number("Spent")) - number("Remaining")) < 0.005
            assert abs(min(100, 100 * number("Spent") / number("Allocated")) - number("Utilization")) < 0.06
    wanted = {name for _, name in [*qx.AGGREGATE_FIELDS, *qx.LOOKUP_FIELDS]}
    assert wanted <= seen and {"Payment Terms", "Last Contact", "Metric", "Year"} <= seen
    asked = generators.typed_questions(df).collect()
    by_pos = {r.pos: r.fields for r in df.collect()}
    assert {q.id.split(" ")[0] for q in asked} == {"Invoice", "Order", "Customer", "Product", "KPI", "Budget"}
    assert all(q.expected and q.expected in q.summary for q in asked) and all(q.expected in by_pos[q.pos].values() for q in asked)
    pairs = generators.style_pairs(df, {"amount": "Betrag", "invoice": "Bill"}, "{summary} ({source})\nKind regards")
    told = pairs.where(F.startswith("output", F.lit("The Bill of"))).collect()
    assert told and all("Betrag" in r.output and r.output.endswith("Kind regards") for r in told)
    assert {"amount of the invoice" in r.instruction for r in told} == {True, False} == {"Betrag of the Bill" in r.instruction for r in told}
    assert {r.instruction.count("\n\n") for r in told} == {1, 2, 3}  # one to three records, and the question
    assert pairs.select(prompts.follows(F.col("output"), "{summary} ({source})\nKind regards").alias("f")).where("not f").count() == 0
    assert prompts.markers("Re: {summary}\nA: {x}\n\nKind regards\n") == ["Re:", "Kind regards"]
    n = generators.write_jsonl(pairs, f"file://{tmp_path}/style")
    written = [json.loads(x) for f in (tmp_path / "style").glob("part*") for x in f.read_text().splitlines()]
    assert n == len(written) == pairs.count() and set(written[0]) == {"instruction", "input", "output"}
    with pytest.raises(ValueError):
        generators.style_pairs(df, {}, "no marker")


def test_neighbours_on_both_sides(spark):
    places = [3 * n for n in range(200)]  # with gaps
    got = generators.neighbours(spark.createDataFrame([(p,) for p in places], "pos long").repartition(5)).collect()
    assert sorted(r.pos for r in got) == places
    near = [(r.pos, x) for r in got for x in (r.near1, r.near2) if x is not None]
    assert all(x % 3 == 0 and 0 < abs(x - p) <= 120 for p, x in near) and all(r.near1 != r.near2 for r in got if r.near1 is not None)
    assert 0.8 < len(near) / len(got) < 1.2
    ahead = sum(x > p for p, x in near) / len(near)
    assert 0.4 < ahead < 0.6 and any(p > 570 for p, _ in near) and any(p < 30 for p, _ in near)
    assert generators.neighbours(spark.createDataFrame([(1,), (2,)], "pos long"), seed=5).count() == 2
    assert all((r.near1, r.near2) == (None, None) for r in generators.neighbours(spark.createDataFrame([(1,)], "pos long")).collect())


PROFILE = {
    "name": "freight", "entities": {"Load": {"prefix": "Load_", "count": 9}, "Haulier": {}},
    "record_types": [
        {"type": "Load", "title": "Load {entity}", "entity": "Load", "weight": 0.5, "tags": ["load"], "fields": [{"name": "Haulier", "kind": "entity", "ref": "Haulier"}, {"name": "Weight", "kind": "int", "min": 5, "max": 9}, {"name": "ETA", "kind": "date"}]},
        {"type": "Freight Bill", "entity": "Haulier", "fields": [{"name": "Amount", "kind": "money"}, {"name": "Status", "kind": "choice", "values": ["open", "paid"]}, {"name": "Discount", "kind": "percent"}]},
    ],
}


def test_profiles(spark, tmp_path):
    (tmp_path / "freight").mkdir()
    (tmp_path / "freight" / "profile.json").write_text(json.dumps(PROFILE, indent=1))
    root = f"file://{tmp_path}"
    assert generators.profile_names(spark, root) == ["freight"] and generators.profile_names(spark, root + "/none") == []
    profile = generators.load_profile(spark, root, "freight")
    rows = generators.profile_records(spark, profile, 200, seed=9).orderBy("pos").collect()
    assert rows == generators.profile_records(spark, profile, 200, seed=9).repartition(5).orderBy("pos").collect()
    assert {r.id.rsplit(" ", 1)[0] for r in rows} == {"Load", "Freight Bill"}
    for r in rows:
        title, *lines = r.text.split("\n")
        assert title == r.id and len(lines) == 3 and all(": " in x for x in lines) and "freight" in r.tags
        if r.id.startswith("Load"):
            assert 5 <= int(lines[1].split(": ")[1]) <= 9 and "load" in r.tags
    load = next(r for r in rows if r.id.startswith("Load"))
    engine = Engine(generators.profile_records(spark, profile, 200, seed=9), Settings(min_score=0.0))
    answer = engine.query(f"What is the status of {rows[0].id.split(' ')[-1]}?")
    assert not answer.refused and load is not None
    for broken in ({"name": "x"}, PROFILE | {"record_types": [PROFILE["record_types"][0] | {"weight": 0}]}, PROFILE | {"record_types": []}):
        with pytest.raises(ValueError):
            generators.checked_profile(broken)
    with pytest.raises(ValueError):
        generators.load_profile(spark, root, "none")


def test_evaluation_sets(spark):
    """Recall and MRR of the vector search against BM25, on questions in other words and with typing errors."""
    e = generators.business_records(spark, 400, customers=60).dropDuplicates(["id"]).withColumn("fields", fx.field_map("text")).cache()
    asked = generators.paraphrases(e).withColumn("typed", generators.with_typos(F.col("query"), "query_id")).withColumn("mixed", generators.shuffled(F.col("query"), "query_id")).cache()
    rows = asked.collect()
    assert len(rows) == e.count() and any(r.typed != r.query for r in rows)
    for r in rows:
        assert sorted(r.mixed.split()) == sorted(r.query.split())
        assert [sorted(w) for w in r.typed.split()] == [sorted(w) for w in r.query.split()]
        assert all(a == b for a, b in zip(r.typed.split(), r.query.split()) if "_" in b or len(b) < 4)
    hv = search.encode(e)
    expected = asked.select("query_id", F.col("target").alias("id"))
    quality = {}
    for c in ("query", "typed", "mixed"):
        q = asked.select("query_id", F.col(c).alias("text"))
        quality[c, "vectors"] = metrics.retrieval_quality(expected, search.hamming_top_k(hv, search.encode(q))).first()
        ranked = search.bm25_top_k(e.select(F.col("id").alias("doc_id"), "text"), q).withColumnRenamed("doc_id", "id")
        quality[c, "bm25"] = metrics.retrieval_quality(expected, ranked).first()
    print({k: (round(v.recall, 3), round(v.mrr, 3)) for k, v in quality.items()})
    assert quality["query", "bm25"].recall > 0.5 and quality["mixed", "bm25"].recall == quality["query", "bm25"].recall
    near = search.sketch_top_k(hv, search.encode(asked.select("query_id", F.col("query").alias("text"))), candidates=10_000)
    exact = search.hamming_top_k(hv, search.encode(asked.select("query_id", F.col("query").alias("text"))))
    assert near.select("query_id", "rank", "pos", "distance").exceptAll(exact.select("query_id", "rank", "pos", "distance")).count() == 0


def test_stream_upsert(spark, tmp_path):
    from factgrid.streaming.upserts import upsert_stream

    src, path = f"file://{tmp_path}/in", f"file://{tmp_path}/ix"
    for rows in ([("A", "1", 1), ("B", "2", 2)], [("A", "3", 3), ("C", "4", 4)]):
        spark.createDataFrame(rows, "id string, text string, at long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, text string, at long").parquet(src)
        upsert_stream(stream, path, "at", f"file://{tmp_path}/cp").awaitTermination()
    assert {r.id: r.text for r in index.load(spark, path).collect()} == {"A": "3", "B": "2", "C": "4"}
