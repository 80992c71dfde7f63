"""The stored index and the audit log: layers, versions, and writers that know only an older end."""

import re

import pytest
from pyspark.sql import functions as F

from factgrid.operators import audit, index, search
from factgrid.operators.policy import apply_policy
from factgrid.plans.engine import Engine, Settings, prepared
from factgrid.plans.tenants import Tenants
from factgrid.sources.records import AccessPolicy
from factgrid.storage import names, stash


def rows(spark, *given):
    return spark.createDataFrame(given, "pos long, id string, text string")


def files(spark, path):
    """Paths of the data files that are read for the newest version, by bucket."""
    at = [r[0] for r in index.load(spark, path).select(F.input_file_name()).distinct().collect()]
    return {b: sorted(f for f in at if f"bucket={b}/" in f) for b in {int(f.split("bucket=")[1].split("/")[0]) for f in at}}


@pytest.fixture
def path(spark, tmp_path):
    base = spark.range(400).select(F.col("id").alias("pos"), F.concat(F.lit("R"), "id").alias("id"), F.concat(F.lit("Customer: C"), "id", F.lit("\nStatus: open")).alias("text"))
    at = f"file://{tmp_path}/ix"
    index.save(prepared(base), at, buckets=8)
    return at


def test_append_writes_a_delta_and_keeps_other_files(spark, path):
    before = files(spark, path)
    vectors = {r.id: r.hv for r in index.load(spark, path).collect()}
    version = index.append(rows(spark, (0, "R7", "Status: paid"), (1, "new", "a"), (2, "R7", "Status: late"), (3, "new", "b")), path)
    assert (version.number, version.entry_count, len(version.layers), version.layers[1]["rows"]) == (2, 401, 2, 2)
    got = {r.id: r for r in index.load(spark, path).collect()}
    assert len(got) == 401 and (got["R7"].pos, got["R7"].text, got["R7"].fields) == (7, "Status: late", {"Status": "late"})
    assert (got["new"].pos, got["new"].text) == (401, "b") and got["new"].hv and got["R7"].hv != vectors["R7"]
    assert all(got[i].hv == v for i, v in vectors.items() if i != "R7")
    assert "ArrowEvalPython" not in index.load(spark, path)._jdf.queryExecution().optimizedPlan().toString()  # no text is encoded again
    touched = set(version.layers[1]["buckets"])
    assert 0 < len(touched) < 8
    index.compact(spark, path)
    after = files(spark, path)
    assert all(after[b] == before[b] for b in before if b not in touched) and all(not set(after[b]) & set(before[b]) for b in touched)
    assert {r.id: r.text for r in index.load(spark, path).collect()} == {i: r.text for i, r in got.items()}
    assert index.vacuum(spark, path) and index.vacuum(spark, path) == [] and index.load(spark, path).count() == 401
    with pytest.raises(Exception):
        index.current(spark, path, 1)


def test_many_appends_are_folded(spark, path):
    for n in range(index.DELTAS + 1):
        version = index.append(rows(spark, (0, "R1", f"v{n}"), (1, f"x{n}", "t")), path)
    assert all(x["kind"] == "base" for x in version.layers) and version.entry_count == 400 + index.DELTAS + 1
    got = index.load(spark, path)
    assert got.count() == version.entry_count and got.where("id = 'R1'").first().text == f"v{index.DELTAS}"
    assert got.select("pos").distinct().count() == version.entry_count


def test_withdraw_repeated_and_missing_ids(spark, path):
    index.append(rows(spark, (0, None, "n"), (1, "", "e"), (2, "", "e")), path)
    assert index.current(spark, path).entry_count == 403  # rows without an id never replace one another
    version = index.withdraw(spark.createDataFrame([("R3",), ("nobody",), (None,)], "id string"), path)
    assert version.entry_count == 402 and index.load(spark, path).where("id = 'R3'").isEmpty()
    assert index.withdraw(spark.createDataFrame([("R3",)], "id string"), path).number == version.number
    index.append(rows(spark, (5, "R3", "again")), path)
    again = index.load(spark, path).where("id = 'R3'").first()
    assert again.text == "again" and again.pos > 400
    index.compact(spark, path)
    assert index.load(spark, path).count() == 403 == index.current(spark, path).entry_count
    assert index.append(rows(spark).limit(0), path).entry_count == 403


def test_the_last_of_repeated_ids_is_replaced(spark, tmp_path):
    base = rows(spark, (0, "A", "1"), (1, "A", "2"), (2, "B", "3"))
    at = f"file://{tmp_path}/ix"
    index.save(base, at)
    delta = rows(spark, (0, "A", "new"), (1, "C", "c"))
    index.append(delta, at)
    expected = {(0, "A", "1"), (1, "A", "new"), (2, "B", "3"), (4, "C", "c")}
    assert {tuple(r) for r in index.load(spark, at).collect()} == expected == {tuple(r) for r in index.upsert(base, delta).collect()}


def test_upsert_makes_what_only_the_base_has(spark):
    base = prepared(rows(spark, (0, "A", "Status: open")))
    got = {r.id: r for r in index.upsert(base, rows(spark, (0, "B", "Status: paid"))).collect()}
    assert got["B"].fields == {"Status": "paid"} and len(got["B"].hv) == 1250


def test_two_writers(spark, path, monkeypatch):
    one, two = Engine.open(spark, path), Engine.open(spark, path)
    one.save(path)
    with pytest.raises(index.Conflict):
        two.save(path)  # it would cover up what it has not seen
    with pytest.raises(index.Conflict):
        index.save(one.entries, path, expected=0)
    enter, raced = index._enter, []

    def slow(spark, path, version):
        if not raced:
            raced.append(True)
            index.append(rows(spark, (0, "other", "o")), path)  # another writer takes the number first
        return enter(spark, path, version)

    monkeypatch.setattr(index, "_enter", slow)
    n = index.current(spark, path).number
    assert index.append(rows(spark, (0, "R9", "late"), (1, "mine", "m")), path).number == n + 2
    got = {r.id: r for r in index.load(spark, path).collect()}
    assert (got["R9"].text, got["other"].text, got["mine"].text) == ("late", "o", "m") and got["other"].pos != got["mine"].pos
    with pytest.raises(index.Conflict):
        raced.clear()
        index.append(rows(spark, (0, "R9", "x")), path, tries=1)
    for e in (one, two):
        e.close()


def test_engine_adds(spark, path):
    engine = Engine.open(spark, path, settings=Settings(min_score=0.0))
    engine.add(spark.createDataFrame([("Invoice Acme_0001", "Customer: Acme_0001\nStatus: paid")], "id string, text string"))
    assert engine.query("What is the status of Acme_0001?").values == ["paid"] and engine.stored[1] == 2
    engine.save(path)
    assert Engine.open(spark, path).entries.count() == 401
    engine.close()
    with pytest.raises(ValueError):
        Engine(rows(spark, (0, "A", "a"))).add(rows(spark, (0, "B", "b")))


def test_tenant_and_stream_append_to_a_stored_index(spark, tmp_path):
    from factgrid.streaming.upserts import upsert_stream

    t = Tenants(spark, f"file://{tmp_path}/tenants")
    t.create("one", rows(spark, (0, "A", "Status: open"), (1, "B", "Status: open")))
    t.add("one", rows(spark, (0, "C", "Status: new")))
    src, path, mark = f"file://{tmp_path}/in", t.path("one", "index"), f"file://{tmp_path}/cp"
    spark.createDataFrame([("A", "Status: paid", 1), ("A", "Status: late", 2), ("D", "d", 3)], "id string, text string, at long").coalesce(1).write.parquet(src)
    upsert_stream(spark.readStream.schema("id string, text string, at long").parquet(src), path, "at", mark).awaitTermination()
    got = {r.id: r for r in t.entries("one").collect()}
    assert {i: r.text for i, r in got.items()} == {"A": "Status: late", "B": "Status: open", "C": "Status: new", "D": "d"}
    assert got["A"].fields == {"Status": "late"} and len(got["D"].hv) == 1250
    version = index.current(spark, path)
    assert index.append(rows(spark, (0, "A", "x")), path, source=mark, batch=0).number == version.number  # the same batch once more


def test_log_with_stale_writers_does_not_fork(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one, two, three = (audit.AuditLog(spark, path) for _ in range(3))
    assert one.record({"question": "a"}) == 1
    assert [two.record({"question": str(n)}) for n in range(4)] == [2, 3, 4, 5]
    assert one.record({"question": "b"}) == 6  # knew only event 1
    assert three.record_all([{"question": str(n)} for n in range(1000)]) == list(range(7, 1007))
    assert [w.record({"question": "c"}) for w in (one, two, three, two, one)] == [1007, 1008, 1009, 1010, 1011]
    ids = [r.id for r in three.events().select("id").collect()]
    assert sorted(ids) == list(range(1, 1012)) and three.verify() == (True, None)
    assert len(names(spark, f"{path}/commits")) == 12  # a thousand events are one file
    assert one.record_all([]) == []
    assert [r.id for r in one.last(2).collect()] == [1010, 1011]
    changed = one.events().withColumn("payload", F.when(F.col("id") == 500, "edited").otherwise(F.col("payload")))
    assert [r.id for r in audit.broken_links(changed).collect()] == [500]


def scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]


def test_a_policy_passes_over_parts_of_files(spark, tmp_path):
    e = spark.range(20_000).select(F.col("id").alias("pos"), F.concat(F.lit("R"), "id").alias("id"), F.concat(F.lit("Region: "), F.when(F.col("id") % 50 == 0, "North").otherwise("South"), F.lit("\nAmount: "), "id").alias("text"))
    path = f"file://{tmp_path}/ix"
    spark.conf.set("parquet.page.row.count.limit", "100")
    try:
        index.save(e.coalesce(1), path, buckets=2, filters=["Region"])
    finally:
        spark.conf.unset("parquet.page.row.count.limit")
    north = AccessPolicy("n", {"Region": frozenset({"NORTH"})}, frozenset({"region"}))
    seen = apply_policy(index.load(spark, path), north)
    assert "by_Region" not in seen.columns and all("Region" not in f for f in seen.first().fields)
    plan = seen.select("pos")._jdf.queryExecution().executedPlan()
    assert "PushedFilters" in plan.toString() and "(by_Region,north)" in plan.toString().replace("EqualTo", "")
    assert "fields" not in scans(seen.select("pos"))[0].split("ReadSchema")[1]  # the map is not read for the test
    assert seen.count() == 400
    rows = seen.select("pos")
    rows.collect()
    metrics = str(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(_leaf(rows).metrics()).get("numOutputRows").value())
    assert 400 <= int(metrics) <= 1000  # of 20,000: pages without the value are passed over
    index.append(rows_of(spark, ("R1", "Region: North"), ("R50", "Region: South"), ("new", "Region: north"), ("none", "x")), path)
    got = {r.id for r in apply_policy(index.load(spark, path), north).collect()}
    assert len(got) == 401 and {"R1", "new"} <= got and "R50" not in got
    index.compact(spark, path)
    assert {r.id for r in apply_policy(index.load(spark, path), north).collect()} == got


def rows_of(spark, *given):
    return rows(spark, *[(n, i, t) for n, (i, t) in enumerate(given)])


def _leaf(df):
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return leaves.head()


def test_filter_columns_with_odd_names(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.save(rows(spark, (0, "A", "Net. `x` price: Low"), (1, "B", "y")), path, filters=["Net. `x` price"])
    index.append(rows(spark, (0, "C", "Net. `x` price: LOW")), path)
    some = AccessPolicy("n", {"Net. `x` price": frozenset({"low"})})
    assert sorted(r.id for r in apply_policy(index.load(spark, path), some).collect()) == ["A", "C"]
    empty = AccessPolicy("n", {"Net. `x` price": frozenset({""})})
    assert [r.id for r in apply_policy(index.load(spark, path), empty).collect()] == ["B"]


def test_stored_sketches(spark, tmp_path):
    base = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("R"), "id").alias("id"), F.concat(F.lit("Customer: C"), "id", F.lit(" city"), F.col("id") % 7, F.lit(" street"), F.col("id") % 11, F.lit(" item"), F.col("id") % 13).alias("text"))
    path = f"file://{tmp_path}/ix"
    index.save(prepared(base), path, buckets=16, sketches=True)
    text = F.concat(F.lit("customer C"), "pos", F.lit(" street"), F.col("pos") % 11)
    asked = search.encode(base.where("pos % 100 = 0").select(F.col("pos").alias("query_id"), text.alias("text"))).select("query_id", "hv")
    same = search.encode(base.where("pos in (5, 6)").select((10_000 + F.col("pos")).alias("query_id"), "text")).select("query_id", "hv")
    asked = stash(asked.unionByName(same))
    truth = search.hamming_top_k(index.load(spark, path), asked)
    key = lambda df: {(r.query_id, r["rank"]): (r.pos, r.distance) for r in df.collect()}
    want, near, sure = key(truth), index.nearest(path, asked), index.nearest(path, asked, exact=True)
    assert "sk:binary" in scans(index.load(spark, path).select("pos", "id", "sk"))[0] and "hv" not in scans(index.load(spark, path).select("pos", "id", "sk"))[0].split("ReadSchema")[1]
    found = near.collect()
    first = lambda rows: sum(want[r.query_id, 1] == (r.pos, r.distance) for r in rows if r["rank"] == 1) / 32
    near5 = lambda rows: sum((r.pos, r.distance) in {want[r.query_id, n] for n in range(1, 6)} for r in rows) / len(want)
    wider = index.nearest(path, asked, candidates=400).collect()
    print("recall of sketches: first", first(found), "of five", near5(found), "; 400 candidates", first(wider), near5(wider), "; certain", len({r.query_id for r in found if r.certain}))
    assert first(found) >= 0.9 and near5(wider) >= 0.9
    assert all(want[r.query_id, r["rank"]] == (r.pos, r.distance) for r in found if r.certain)
    assert key(sure) == want and all(r.certain for r in sure.collect())
    one = index.nearest(path, same, k=1)
    assert {(r.query_id, r.pos, r.distance, r.certain) for r in one.collect()} == {(10_005, 5, 0, True), (10_006, 6, 0, True)}  # nothing can be nearer
    few = index.nearest(path, same.where("query_id = 10005"), k=1, candidates=2)
    read = [x.split("PartitionFilters: [")[1].split("]")[0] for x in scans(few) if "hv:binary" in x]
    assert read and all("bucket" in x and len(re.findall(r"\b\d+\b", x.split("bucket", 1)[1].split("#", 1)[1])) <= 3 for x in read)  # the column's number and two of 16 buckets
    index.append(rows_of(spark, ("R5", "gone elsewhere"), ("X", "Customer: C5 city5 street5 item5")), path)
    assert [(r.id, r.distance) for r in index.nearest(path, same.where("query_id = 10005"), k=1).collect()] == [("X", 0)]
    index.save(rows(spark, (0, "A", "a")), f"file://{tmp_path}/plain")
    with pytest.raises(ValueError):
        index.nearest(f"file://{tmp_path}/plain", same)
