"""The pipeline's stages, each judged on its own input."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from factgrid.llm.common import stash
from factgrid.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import base, near, repeats


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "minhash", "suffix", "pii", "packing"]
    clean = stash(steps["toxicity"](spark, docs, sf))
    assert clean.columns == cols and 0 < clean.count() <= docs.count()
    single = stash(steps["minhash"](spark, clean, sf))
    kept = {i for i, (_, _, k) in near(rows(clean), 5).items() if k}
    assert single.columns == cols and {i for i, _ in rows(single)} == kept
    cut = stash(steps["suffix"](spark, single, sf))
    want = repeats(rows(single))
    touched = 0
    for i, t in rows(cut):
        if hashlib.sha256((t or "").encode()).hexdigest() != want[i][3]:
            touched += 1  # a character lost only some of its bytes
    assert cut.columns == cols and touched <= 0.05 * len(want)
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0
    safe = stash(steps["pii"](spark, cut, sf))
    assert safe.columns == cols and all(base(t) == "" for _, t in rows(safe)) and safe.count() == cut.count()
    packed = steps["packing"](spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, and columns named like those the operators use."""
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    long = "one sentence of some words that stands in two of the texts " * 2
    data = [(1, long + "x"), (2, long + "x"), (3, None), (4, ""), (None, long), (None, None), (5, "mail me: a@b.co or 10.0.0.1"), (5, "mail me: a@b.co or 10.0.0.1"), (6, "y " + long[:70] + " z")]
    clash = "g long, score string, kept string, spans string, task string, length string, start string, version string, component_id string, id string, r string, found string"
    names = [c.split()[0] for c in clash.split(", ")]
    rows_in = [(i, t, len(t or ""), n, *[f"{c}{n}" for c in names[1:]]) for n, (i, t) in enumerate(data)]
    docs = spark.createDataFrame(rows_in, f"doc_id long, text string, n_chars long, {clash}")
    steps = dict(corpus_pipeline.STAGES)

    def of(name, given):
        out = stash(steps[name](spark, given, sf))
        assert out.columns == given.columns and out.schema.simpleString() == given.schema.simpleString()
        got = out.collect()
        assert all(r[c] == (r.g if c == "g" else f"{c}{r.g}") for r in got for c in names)
        return out, {r.g: r.text for r in got}

    clean, got = of("toxicity", docs)
    assert got == {n: t for n, (_, t) in enumerate(data)}
    single, got = of("minhash", clean)
    assert got == {n: t for n, (_, t) in enumerate(data) if n != 1}
    cut, got = of("suffix", single)
    assert got[0] == long + "x" and got[8] == "y z" and got[2] is None and got[4] == long and got[6] == got[7] == data[6][1]
    safe, got = of("pii", cut)
    assert got[6] == got[7] == "mail me: [EMAIL] or [IP]" and got[3] == "" and got[5] is None
    packed = steps["packing"](spark, safe, sf).collect()
    assert len(packed) == 8 and sum(r.doc_id is None for r in packed) == 2 and sum(r.length for r in packed if r.doc_id in (3, 4)) == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
