"""Registered queries of the record operators over the shared tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions import questions as qx
from ..operators import aggregates, audit, index, metrics, policy, search, verified
from ..operators.bm25 import Bm25
from ..sources import generators, records
from ..sources.records import AccessPolicy
from ..storage import folder, stash
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_entries(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders rendered as records: ``pos, id, text, fields``, and ``more`` of an order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    o = o.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "paid").otherwise("confirmed")
    rows = o.select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("Order_"), "o_orderkey").alias("id"),
        F.replace("c_name", F.lit("#"), F.lit("_")).alias("Customer"),
        F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).alias("Amount"),
        status.alias("Status"),
        F.col("r_name").alias("Region"),
        F.col("o_orderpriority").alias("Priority"),
        *more,
    )
    text = F.concat_ws("\n", "id", *[F.concat(F.lit(f"{c}: "), c) for c in ("Customer", "Amount", "Status", "Region", "Priority")])
    return rows.select("pos", "id", text.alias("text"), *rows.columns[7:]).withColumn("fields", fx.field_map("text"))


E_SQL = """e AS (SELECT o_orderkey AS pos, 'Order_' || o_orderkey AS id, replace(c_name, '#', '_') AS customer, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'paid' ELSE 'confirmed' END AS status, r_name AS region, o_orderpriority AS priority
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MONEY = "'$' || format('{:,.2f}', amount)"
TEXT = f"id || chr(10) || 'Customer: ' || customer || chr(10) || 'Amount: ' || {MONEY} || chr(10) || 'Status: ' || status || chr(10) || 'Region: ' || region || chr(10) || 'Priority: ' || priority"


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey AS VARCHAR) || chr(10) || 's_name: ' || s_name || chr(10) || 's_nationkey: ' || s_nationkey AS text, s_name AS tag FROM supplier")
def src01_records(spark, sf_dir):
    e = records.entries_from_records(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_nationkey"], ["s_name"])
    return e.select("id", "text", F.get("tags", F.lit(0)).alias("tag"))


@query("SELECT 'row_' || (row_number() OVER (ORDER BY r_regionkey) - 1) AS id, 'r_name: ' || r_name AS text FROM region")
def src01_numbered(spark, sf_dir):
    return records.entries_from_records(table(spark, sf_dir, "region").orderBy("r_regionkey"), None, ["r_name"]).select("id", "text")


@query(f"WITH {E_SQL} SELECT id, customer, {MONEY} AS amount, status, region FROM e")
def prj01_fields(spark, sf_dir):
    f = lambda n: fx.field("fields", n)
    return order_entries(spark, sf_dir).select("id", f("Customer").alias("customer"), f("Amount").alias("amount"), f("Status").alias("status"), f("Region").alias("region"))


@query(f"WITH {E_SQL} SELECT id, CAST(amount AS DECIMAL(38,2)) AS amount FROM e")
def prj02_amount(spark, sf_dir):
    return order_entries(spark, sf_dir).select("id", fx.amount(fx.field("fields", "Amount")).alias("amount"))


@query(f"WITH {E_SQL} SELECT pos, customer AS entity FROM e")
def prj03_entity(spark, sf_dir):
    e = order_entries(spark, sf_dir)
    return e.select("pos", fx.entity_key(F.concat(F.lit("Record of "), fx.field("fields", "Customer"), F.lit(" (2024)"))).alias("entity"))


@query(f"WITH {E_SQL} SELECT id, id || chr(10) || 'Customer: ' || customer || chr(10) || 'Status: ' || status || chr(10) || 'Region: ' || region || chr(10) || '(2 field(s) redacted by policy)' AS text FROM e")
def prj04_redact(spark, sf_dir):
    return order_entries(spark, sf_dir).select("id", fx.redacted("text", ["AMOUNT", "priority"]).alias("text"))


@query(f"WITH {E_SQL} SELECT id, {TEXT} || chr(10) || 'Source: ' || id AS answer FROM e")
def prj05_template(spark, sf_dir):
    return order_entries(spark, sf_dir).select("id", verified.filled(verified.TEMPLATE, F.col("text"), F.col("id")).alias("answer"))


@query("SELECT p_name AS id, p_name || chr(10) || 'Brand: ' || p_brand AS text, p_brand AS tag, 'Tell me about ' || p_name AS instruction, 'Brand: ' || p_brand AS output FROM part")
def prj05_formats(spark, sf_dir):
    """Records as retrieval entries and as training rows."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(F.lit("Brand: "), "p_brand").alias("content"), F.array("p_brand").alias("tags"))
    both = p.withColumn("r", F.struct("title", "content", "tags"))
    entry = records.retrieval_format(both.select("r.*")).select("id", "text", F.get("tags", F.lit(0)).alias("tag")).distinct()
    train = records.training_format(both.select("r.*"), "Tell me about {title}").select(F.substring_index("instruction", "about ", -1).alias("id"), "instruction", "output", F.substring_index("output", ": ", -1).alias("tag"))
    return train.join(entry, ["id", "tag"]).select("id", "text", "tag", "instruction", "output")


@query(f"WITH {E_SQL} SELECT id FROM e WHERE status = 'open' AND region IN ('ASIA', 'EUROPE')")
def flt01_equal(spark, sf_dir):
    return order_entries(spark, sf_dir).where(policy.visible(AccessPolicy("x", {"Status": frozenset({"OPEN"}), "Region": frozenset({"asia", "europe"})}))).select("id")


@query(f"WITH {E_SQL} SELECT id FROM e WHERE contains(lower({TEXT}), 'customer_00000001')")
def flt02_entity(spark, sf_dir):
    return order_entries(spark, sf_dir).where(aggregates.mentions("Customer_00000001")).select("id")


@query(f"WITH {E_SQL} SELECT id, amount > 250000.5 AS over, amount < 1000 AS under FROM e WHERE amount > 250000.5 OR amount < 1000")
def flt03_threshold(spark, sf_dir):
    v = fx.amount(fx.field("fields", "Amount"))
    return order_entries(spark, sf_dir).select("id", aggregates.beyond(v, Decimal("250000.5")).alias("over"), aggregates.beyond(v, 1000, below=True).alias("under")).where("over or under")


EU = AccessPolicy("eu", {"Region": frozenset({"Europe"})}, frozenset({"amount"}))


@query(f"WITH {E_SQL} SELECT id, id || chr(10) || 'Customer: ' || customer || chr(10) || 'Status: ' || status || chr(10) || 'Region: ' || region || chr(10) || 'Priority: ' || priority || chr(10) || '(1 field(s) redacted by policy)' AS text, CAST(NULL AS VARCHAR) AS amount FROM e WHERE lower(region) = 'europe'")
def flt05_policy(spark, sf_dir):
    return policy.apply_policy(order_entries(spark, sf_dir), EU).select("id", "text", fx.field("fields", "Amount").alias("amount"))


@query(ORACLE_SQL["flt05_policy"])
def flt05_stored(spark, sf_dir):
    """The same rows from a stored index whose files are ordered by the filter's field, after a third of the orders have been appended again."""
    e, path = order_entries(spark, sf_dir).select("pos", "id", "text"), folder(spark)  # field maps follow from the texts, of visible rows when they are read
    old = F.when(F.col("pos") % 3 == 0, F.replace("text", F.lit("Region: "), F.lit("Region: NOT "))).otherwise(F.col("text"))
    index.save(e.withColumn("text", old), path, filters=["Region", "Status"])
    index.append(e.where("pos % 3 = 0"), path)
    return policy.apply_policy(index.load(spark, path), EU).select("id", "text", fx.field("fields", "Amount").alias("amount"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey || chr(10) || 'name, with key: ' || c_name || chr(10) || 'segment: ' || '\"' || c_mktsegment || '\", a; b' || chr(10) || 'balance: ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS text FROM customer")
def src02_delimited(spark, sf_dir):
    """Customers written with semicolons, a comma in the header and quoted cells that hold both, and read back by what is found."""
    path = folder(spark)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name, with key"), F.concat(F.lit('"'), "c_mktsegment", F.lit('", a; b')).alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    c.write.csv(path, sep=";", header=True, escape='"')
    return records.read_csv(spark, path, id_column="key").select("id", "text")


QUESTIONS = [
    "What is the total amount of all open orders?",
    "What is the average amount of paid orders?",
    "How many records are confirmed?",
    "What is the highest amount?",
    "What is the lowest amount of open orders?",
    "How many invoices worth more than $250,000 are there?",
    "Are there any amounts over 9,000,000?",
    "Was ist die Summe der Betrag Werte, insgesamt über 400000?",
    "What is the total amount of Customer_000000007?",
    "What is the total amount of Customer_999999999?",
    "Who is our best customer?",
    "How many units of Product_0001 are in stock?",
]


def _questions(spark: SparkSession, texts=None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts or QUESTIONS)), "query_id long, question string")


@query(f"""WITH {E_SQL}, a AS (
  SELECT 0 AS k, 'sum' AS operation, 'Amount' AS field, format('{{:,.2f}}', sum(amount)) AS value, count(*) AS record_count FROM e WHERE status = 'open' UNION ALL
  SELECT 1, 'avg', 'Amount', format('{{:,.2f}}', round(CAST(sum(amount) AS DECIMAL(38,6)) / count(*), 2)), count(*) FROM e WHERE status = 'paid' UNION ALL
  SELECT 2, 'count', NULL, CAST(count(*) AS VARCHAR), count(*) FROM e WHERE status = 'confirmed' UNION ALL
  SELECT 3, 'max', 'Amount', format('{{:,.2f}}', max(amount)), count(*) FROM e UNION ALL
  SELECT 4, 'min', 'Amount', format('{{:,.2f}}', min(amount)), count(*) FROM e WHERE status = 'open' UNION ALL
  SELECT 5, 'count', 'Amount', format('{{:,}}', count(*)), count(*) FROM e WHERE amount > 250000 UNION ALL
  SELECT 6, 'count', NULL, CAST(NULL AS VARCHAR), 0 WHERE false UNION ALL
  SELECT 7, 'sum', 'Amount', format('{{:,.2f}}', sum(amount)), count(*) FROM e WHERE amount > 400000 UNION ALL
  SELECT 8, 'sum', 'Amount', CASE WHEN count(*) > 0 THEN format('{{:,.2f}}', sum(amount)) END, count(*) FROM e WHERE customer = 'Customer_000000007' HAVING count(*) > 0)
  SELECT operation, field, value, CAST(record_count AS BIGINT) AS record_count FROM a""")
def agg08_questions(spark, sf_dir):
    return aggregates.answer_aggregates(order_entries(spark, sf_dir), _questions(spark)).select("operation", "field", "value", "record_count")


@query(f"""WITH {E_SQL}, b AS (SELECT DISTINCT abs(CAST(c_acctbal AS DECIMAL(18,2))) * 20 AS b FROM customer)
  SELECT 'What is the total amount of all open orders of ' || customer || '?' AS question, CASE WHEN count(*) FILTER (WHERE status = 'open') > 0 THEN format('{{:,.2f}}', sum(amount) FILTER (WHERE status = 'open')) END AS value, count(*) FILTER (WHERE status = 'open') AS record_count FROM e GROUP BY customer UNION ALL
  SELECT 'How many records with an amount over $' || b || ' are there?', format('{{:,}}', count(amount)), count(amount) FROM b LEFT JOIN e ON amount > b GROUP BY b UNION ALL
  SELECT 'What is the lowest paid amount less than $' || b || '?', format('{{:,.2f}}', min(amount)), count(amount) FROM b LEFT JOIN e ON amount < b AND status = 'paid' GROUP BY b""")
def agg08_thousands(spark, sf_dir):
    """A question about every customer's open orders, and two with each customer's own bound, answered in one scan of all orders."""
    c = table(spark, sf_dir, "customer")
    b = c.select((F.abs(F.col("c_acctbal").cast("decimal(18,2)")) * 20).cast("string").alias("b")).distinct()
    asked = c.select(F.concat(F.lit("What is the total amount of all open orders of "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("?")).alias("question"))
    asked = asked.union(b.select(F.concat(F.lit("How many records with an amount over $"), "b", F.lit(" are there?")))).union(b.select(F.concat(F.lit("What is the lowest paid amount less than $"), "b", F.lit("?"))))
    return aggregates.answer_aggregates(order_entries(spark, sf_dir), asked).select("question", "value", "record_count")


@query(f"WITH {E_SQL} SELECT CAST(sum(amount) AS DECIMAL(38,2)) AS total, count(*) AS n, max(amount) AS most, CAST(round(CAST(sum(amount) AS DECIMAL(38,6)) / count(*), 2) AS DECIMAL(38,2)) AS mean FROM e WHERE status = 'open'")
def agg03_open_orders(spark, sf_dir):
    """Four questions about the open orders, answered in one scan."""
    asked = _questions(spark, [f"What is the {w} amount of all open orders?" for w in ("total", "highest", "average")] + ["How many open orders with an amount are there?"])
    told = aggregates.answer_aggregates(order_entries(spark, sf_dir), asked)
    of = lambda name, kind: F.max(F.when(F.col("operation") == name, F.replace("value", F.lit(","), F.lit("")))).cast(kind)
    return told.agg(of("sum", "decimal(38,2)").alias("total"), of("count", "long").alias("n"), of("max", "decimal(18,2)").alias("most"), of("avg", "decimal(38,2)").alias("mean"))


@query(f"WITH {E_SQL}, g AS (SELECT customer AS entity, list_sort(list_distinct(list(status))) AS v FROM e GROUP BY 1) SELECT entity, array_to_string(v, ',') AS vals, CAST(len(v) AS INTEGER) AS n_values FROM g WHERE len(v) > 1")
def agg09_conflicts(spark, sf_dir):
    e = order_entries(spark, sf_dir).withColumn("text", F.concat(fx.field("fields", "Customer"), F.lit("\n"), "text"))
    return verified.conflicts(e, "Status").select("entity", F.array_join("values", ",").alias("vals"), "n_values")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), b AS (SELECT w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT w FROM t)),
  c AS (SELECT doc_id, w, count(*) AS k FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY 1),
  v AS (SELECT doc_id, i, sum(k * ((h >> i) & 1)) AS s FROM c JOIN b USING (w), range(32) r(i) GROUP BY ALL)
  SELECT v.doc_id, CAST(sum(CASE WHEN 2 * s > n THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS bits FROM v JOIN n USING (doc_id) GROUP BY 1""")
def agg10_majority(spark, sf_dir):
    """The bundling operator with short token vectors, which SQL can make, too."""
    hv = search.encode(table(spark, sf_dir, "documents").select("doc_id", "text").where(F.size(fx.words("text")) > 0), encoding="md5-32")
    return hv.select("doc_id", F.conv(F.hex("hv"), 16, 10).cast("long").alias("bits"))


@query(f"WITH {E_SQL} SELECT DISTINCT lower(customer) AS name FROM e UNION SELECT lower(id) FROM e")
def agg11_vocabulary(spark, sf_dir):
    return index.known_entities(order_entries(spark, sf_dir))


BM25 = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
  q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
  d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  r AS (SELECT query_id, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)"""


def _bm25(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_top_k(table(spark, sf_dir, "documents").select("doc_id", "text"), q)


@query(f"{BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM k WHERE rank <= 5")
def agg13_bm25(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "rank", "doc_id")


_SHORT = BM25.replace("lower(text), '[a-z0-9]+')) AS term FROM benchmark)", "lower(array_to_string(list_slice(string_split(text, ' '), 3, 8), ' ')), '[a-z0-9]+')) AS term FROM benchmark)")


@query(f"{_SHORT} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM k WHERE rank <= 5")
def agg12_stored(spark, sf_dir):
    """Six words of each benchmark item asked of stored postings, most of which are passed over."""
    path = folder(spark)
    Bm25.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path=path)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 3, 6), " ").alias("text"))
    return Bm25.open(spark, path).top_k(q).select("query_id", "rank", "doc_id")


@query(f"{BM25}, x AS (SELECT query_id, min(doc_id) AS doc_id FROM k WHERE rank <= 3 GROUP BY 1) SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, count(*) AS n FROM x LEFT JOIN (SELECT * FROM k WHERE rank <= 5) y USING (query_id, doc_id)")
def agg14_quality(spark, sf_dir):
    r = stash(_bm25(spark, sf_dir).withColumnRenamed("doc_id", "id"))  # read twice
    expected = r.where("rank <= 3").groupBy("query_id").agg(F.min("id").alias("id"))
    return metrics.retrieval_quality(expected, r).select(F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "n")


@query("WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n, avg(value) AS m, median(value) AS d FROM events) SELECT round(m, 6) AS mean, round(d, 6) AS median, v[1 + CAST(floor(0.95 * (n - 1)) AS BIGINT)] AS p95, n FROM s")
def agg15_latency(spark, sf_dir):
    x = metrics.latency(table(spark, sf_dir, "events"), "value")
    return x.select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95", "n")


@query(f"WITH {E_SQL} SELECT customer AS title, max(pos) AS pos, arg_max(status, pos) AS status FROM e GROUP BY 1")
def agg16_keep_last(spark, sf_dir):
    e = order_entries(spark, sf_dir).select(fx.field("fields", "Customer").alias("title"), "pos", fx.field("fields", "Status").alias("status"))
    return index.keep_last(e, "title", "pos")


@query("SELECT count(*) AS entries, count(*) * 1250 AS index_bytes FROM orders")
def agg17_size(spark, sf_dir):
    return index.size(table(spark, sf_dir, "orders"))


@query("SELECT round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 9) AS refused, round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 9) AS slow FROM events")
def agg20_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("refused"), (F.col("value") > 10).alias("slow"))
    return metrics.rates(e, ["refused", "slow"]).select(F.round("refused", 9).alias("refused"), F.round("slow", 9).alias("slow"))


@query("SELECT count(*) FILTER (WHERE event_type <> 'purchase') AS misses, count(*) FILTER (WHERE event_type <> 'purchase' AND value <= 5) AS retrieval_misses, count(*) FILTER (WHERE event_type <> 'purchase' AND value > 5) AS extraction_failures FROM events")
def agg19_misses(spark, sf_dir):
    return metrics.misses(table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").alias("correct"), (F.col("value") > 5).alias("retrieved")))


def _signs(spark, sf_dir):
    """Vectors as packed sign bits."""
    bit = F.transform(F.col("embedding"), lambda x: F.when(x > 0, "1").otherwise("0"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.unhex(F.lpad(F.conv(F.array_join(bit, ""), 2, 16), 16, "0")).alias("hv"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS pos, CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM v q, v WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pos) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, distance, 1 - distance / 64 AS score FROM r WHERE rank <= 5""")
def jn01_hamming(spark, sf_dir):
    e = _signs(spark, sf_dir)
    q = e.where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "hv")
    return search.hamming_top_k(e, q, 5, bits=64).select("query_id", "rank", "pos", "distance", "score")


@query(ORACLE_SQL["jn01_hamming"])
def top03_certain(spark, sf_dir):
    """The same rows by sketches stored with the vectors; where these leave it open, by all vectors."""
    e, path = _signs(spark, sf_dir), folder(spark)
    index.save(e, path, dimensions=64, sketches=True)
    q = e.where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "hv")
    return index.nearest(path, q, 5, exact=True).select("query_id", "rank", "pos", "distance", "score")


def _margins(v: pd.Series) -> pd.Series:
    """Bits of vectors, of 128 at a time: each takes three times 10,000 doubles on the way."""
    x, out = np.arange(10_000), []
    i = x // 5 % 64
    for first in range(0, len(v), 128):
        e = np.stack(v.iloc[first : first + 128].to_numpy()).astype(float)
        out += [r.tobytes() for r in np.packbits(e[:, i] > e[:, (i + x // 320 + 1) % 64] + x % 5 / 16, axis=1)]
    return pd.Series(out, dtype=object)


@query("""WITH v AS (SELECT vec_id, list_transform(range(10000), lambda x: CASE WHEN CAST(embedding[1 + x // 5 % 64] AS DOUBLE) > CAST(embedding[1 + (x // 5 % 64 + x // 320 + 1) % 64] AS DOUBLE) + x % 5 / 16 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE len(embedding) = 64),
  s AS (SELECT vec_id, CAST(array_to_string(b, '') AS BIT) AS b FROM v), d AS (SELECT q.vec_id AS query_id, s.vec_id AS pos, CAST(bit_count(xor(q.b, s.b)) AS BIGINT) AS distance FROM s q, s WHERE q.vec_id % 10 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pos) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, distance, 1 - distance / 10000 AS score FROM r WHERE rank <= 5""")
def jn01_bits(spark, sf_dir):
    """Nearest by stored vectors of 10,000 bits: the signs of differences of an embedding's components, against five margins."""
    packed = F.pandas_udf(_margins, "binary")
    v = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    e = stash(v.select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), packed("embedding").alias("hv")))
    return search.hamming_top_k(e, e.where("pos % 10 = 0").select(F.col("pos").alias("query_id"), "hv")).select("query_id", "rank", "pos", "distance", "score")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, label FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS pos, CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM v q, v WHERE q.vec_id % 50 = 0 AND v.label = 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pos) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, distance FROM r WHERE rank <= 5""")
def flt09_subset_search(spark, sf_dir):
    e = _signs(spark, sf_dir)
    q = e.where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "hv")
    seen = e.join(table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("pos")), "pos", "left_semi")
    return search.hamming_top_k(seen, q, 5, bits=64).select("query_id", "rank", "pos", "distance")


NAMES = "(VALUES (0, 'customer_000000001'), (1, 'customer_00000012'), (2, 'order_77'), (3, 'nobody_1'))"


@query(f"WITH {E_SQL}, n AS (SELECT * FROM {NAMES} t(query_id, name)), h AS (SELECT query_id, pos, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM e, n WHERE contains(lower({TEXT}), name) OR contains(lower(id), name)) SELECT CAST(query_id AS BIGINT) AS query_id, pos, id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 5")
def jn02_scan(spark, sf_dir):
    names = spark.createDataFrame([(0, "customer_000000001"), (1, "customer_00000012"), (2, "order_77"), (3, "nobody_1")], "query_id long, name string")
    return verified.scan_for(order_entries(spark, sf_dir), names).select("query_id", "pos", "id", "rank")


@query("SELECT CAST(o_orderkey AS BIGINT) AS pos, 'Order_' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1 + c_custkey, 'New_' || c_custkey, 'new' FROM customer")
def jn04_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Order_"), "o_orderkey").alias("id"), F.lit("old").alias("text"))
    again = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Order_"), "o_orderkey").alias("id"), F.lit("new").alias("text"))
    fresh = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("New_"), "c_custkey").alias("id"), F.lit("new").alias("text"))
    return index.upsert(base, again.union(fresh))


@query(ORACLE_SQL["jn04_upsert"])
def snk01_append(spark, sf_dir):
    """The same changes, made in two appends to an index that the engine has stored, then folded into it."""
    o = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("Order_"), "o_orderkey"))
    path = folder(spark)
    Engine(o.select(F.col("o_orderkey").alias("pos"), "id", F.lit("old").alias("text"))).save(path)
    index.append(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pos"), "id", F.lit("new").alias("text")), path)
    fresh = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("New_"), "c_custkey").alias("id"), F.lit("new").alias("text"))
    index.append(fresh, path)
    index.compact(spark, path)
    return index.load(spark, path).select("pos", "id", "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def jn05_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return index.delete(o, o.where("o_orderstatus = 'P'")).select(F.col("id").alias("o_orderkey"))


@query("SELECT p_partkey AS query_id, n.name FROM part, (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS name FROM part) n WHERE contains(lower(p_name), n.name) AND length(n.name) >= 4")
def jn06_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    vocabulary = p.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct()
    return verified.mentioned(p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question")), vocabulary)


@query(f"WITH {E_SQL} SELECT pos AS query_id, customer AS value FROM e WHERE region = 'ASIA'")
def jn09_leaks(spark, sf_dir):
    """All customer names looked for in all orders of a region."""
    out = order_entries(spark, sf_dir).where(fx.field("fields", "Region") == "ASIA").select(F.col("pos").alias("query_id"), "text")
    secret = table(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("#"), F.lit("_")).alias("value"))
    return metrics.leaks(out, secret)


def _chain(spark, sf_dir):
    """Events as a hash-linked log in which every thousandth payload was edited and one event removed."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("p"))
    before = e.select((F.col("id") + 1).alias("id"), F.sha2("p", 256).alias("prev_sha256"))
    e = e.join(before, "id", "left").withColumn("prev_sha256", F.coalesce("prev_sha256", F.lit("")))
    return e.select("id", F.when(F.col("id") % 1000 == 7, F.concat("p", F.lit("!"))).otherwise(F.col("p")).alias("payload"), "prev_sha256", F.sha2("p", 256).alias("event_sha256")).where("id <> 500")


@query("""WITH e AS (SELECT event_id AS id, event_id || '|' || event_type || '|' || user_id AS p FROM events), l AS (SELECT id, p, coalesce(lag(sha256(p)) OVER (ORDER BY id), '') AS prev, sha256(p) AS own FROM e),
  c AS (SELECT id, prev, own, CASE WHEN id % 1000 = 7 THEN p || '!' ELSE p END AS payload FROM l WHERE id <> 500)
  SELECT id FROM (SELECT id, prev, own, payload, coalesce(lag(own) OVER (ORDER BY id), '') AS before FROM c) WHERE prev <> before OR sha256(payload) <> own""")
def win01_chain(spark, sf_dir):
    """Broken places of a linked log (here an event's hash covers its own payload)."""
    return audit.broken_links(_chain(spark, sf_dir), own=F.sha2("payload", 256), per_range=4096)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def top04_newest(spark, sf_dir):
    return audit.newest(table(spark, sf_dir, "events").select("event_id", "event_type"), 50, "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def win04_last_turns(spark, sf_dir):
    return index.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
  SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(greatest(len(w) - 1, 0) AS INTEGER) AS n_pairs, CASE WHEN len(w) > 1 THEN w[1] || '_' || w[2] END AS first_pair FROM t""")
def scl01_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", fx.words("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size(fx.bigrams(F.col("w"))).alias("n_pairs"), F.get(fx.bigrams(F.col("w")), F.lit(0)).alias("first_pair"))


@query("""SELECT * FROM (VALUES (0, 'sum', 'Amount', 'open', NULL, NULL), (1, 'avg', 'Amount', 'paid', NULL, NULL), (2, 'count', NULL, 'confirmed', NULL, NULL), (3, 'max', 'Amount', NULL, NULL, NULL),
  (4, 'min', 'Amount', 'open', NULL, NULL), (5, 'count', 'Amount', NULL, CAST(250000 AS DECIMAL(38,2)), NULL), (6, NULL, NULL, NULL, CAST(9000000 AS DECIMAL(38,2)), NULL), (7, 'sum', 'Amount', NULL, CAST(400000 AS DECIMAL(38,2)), NULL),
  (8, 'sum', 'Amount', NULL, NULL, 'customer_000000007'), (9, 'sum', 'Amount', NULL, NULL, 'customer_999999999'), (10, NULL, NULL, NULL, NULL, NULL), (11, NULL, 'Stock', NULL, NULL, 'product_0001')) t(query_id, operation, field, status, bound, entity)""")
def scl08_parse(spark, sf_dir):
    return qx.parse(_questions(spark)).select(F.col("query_id").cast("int").alias("query_id"), "operation", "field", "status", "bound", "entity")


@query("SELECT o_orderkey AS pos, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS DECIMAL(38,2)) AS invented FROM orders")
def set02_grounding(spark, sf_dir):
    """Answers with one invented figure: that figure alone is found (others are the record's own, or too small to matter)."""
    e = order_entries(spark, sf_dir)
    v = fx.amount(fx.field("fields", "Amount"))
    answer = F.concat(F.lit("Paid "), fx.field("fields", "Amount"), F.lit(" of "), (v + 1).cast("decimal(18,2)").cast("string"), F.lit(" ("), (F.col("pos") % 100).cast("string"), F.lit(")"))
    return e.select("pos", F.array_join(fx.ungrounded(answer, F.col("text"), F.lit("")), " ").cast("decimal(38,2)").alias("invented"))


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{m}')" for m in fx.AGGREGATION_MARKERS) + " AS marked FROM conversations")
def scl18_markers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.asks_for_aggregate(F.col("text")).alias("marked"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\bwidget\\b', 'gadget', 'gi'), '\\bred\\b', 'crimson', 'gi') AS name FROM part")
def scl20_glossary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.with_glossary(F.col("p_name"), {"widget": "gadget", "red": "crimson"}).alias("name"))


@query(f"WITH {E_SQL} SELECT id, replace(lower(format('{{:.2f}}', amount)), ',', '') AS v, sha256({TEXT}) AS h FROM e")
def scl23_digests(spark, sf_dir):
    return order_entries(spark, sf_dir).select("id", fx.normal_value(fx.field("fields", "Amount")).alias("v"), F.sha2("text", 256).alias("h"))


@query("""WITH k AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
  SELECT query_id, CAST(count(*) FILTER (WHERE a <= 5 AND b <= 5) AS DOUBLE) / 5 AS overlap FROM k GROUP BY 1""")
def set03_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    by = lambda *order: o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return metrics.overlap(by(F.desc("o_totalprice"), "id"), by("id"))


@query(f"WITH {E_SQL} SELECT DISTINCT customer FROM e WHERE region = 'EUROPE' EXCEPT SELECT customer FROM e WHERE status = 'open'")
def set05_difference(spark, sf_dir):
    e = order_entries(spark, sf_dir).select(fx.field("fields", "Customer").alias("id"), fx.field("fields", "Region").alias("region"), fx.field("fields", "Status").alias("status"))
    return index.delete(e.where("region = 'EUROPE'").select("id").distinct(), e.where("status = 'open'")).select(F.col("id").alias("customer"))


@query(f"""WITH {E_SQL}, q AS (SELECT pos, customer, status FROM e), g AS (SELECT customer, list_sort(list_distinct(list(status))) AS v FROM q WHERE customer IN (SELECT replace(c_name, '#', '_') FROM customer WHERE c_custkey < 40) GROUP BY 1)
  SELECT CAST(right(customer, 9) AS BIGINT) AS query_id, CASE WHEN len(v) > 1 THEN 'ambiguous' ELSE 'field' END AS path, array_to_string(v, ',') AS vals FROM g""")
def ver01_answers(spark, sf_dir):
    """Verified status questions about forty customers: BM25 hits, names and scans over all records."""
    e = order_entries(spark, sf_dir).withColumn("c", fx.field("fields", "Customer")).withColumn("id", F.concat(F.lit("Order of "), "c"))
    e = stash(e.select("pos", "id", "text", "c"))  # read several times
    asked = e.select(F.right("c", F.lit(9)).cast("long").alias("query_id"), "c").where("query_id < 40").distinct()
    q = asked.select("query_id", F.concat(F.lit("What is the status of "), "c", F.lit("?")).alias("question"))
    # as many hits as the customer with most records has, so that no record is left out
    most = e.groupBy("c").count().agg(F.max("count")).first()[0] or 1
    hits = stash(search.bm25_top_k(e.select(F.col("pos").alias("doc_id"), "text"), q.withColumnRenamed("question", "text"), most))
    ranked = hits.withColumnRenamed("doc_id", "pos").join(e.select("pos", "id", "text"), "pos")
    ranked = stash(ranked.select("query_id", "rank", "id", "text", "score"))  # read several times
    return verified.answer_verified(q, ranked, e.select("pos", "id", "text"), e.select(F.lower("c").alias("name")).distinct()).select("query_id", "path", F.array_join("values", ",").alias("vals"))


@query()
def hdc_search(spark, sf_dir):
    """10,000-bit vectors of all parts, and the five nearest parts of every fiftieth."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Part_"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("text"))
    return search.nearest_texts(e, e.where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "text"))


@query()
def src06_generate(spark, sf_dir):
    """As many generated records as there are orders."""
    return generators.business_records(spark, table(spark, sf_dir, "orders").count())


@query()
def src07_profile(spark, sf_dir):
    """Records of an industry profile, as many as there are orders."""
    profile = {
        "name": "freight", "entities": {"Load": {"prefix": "Load_", "count": 300}, "Haulier": {"prefix": "Haulier_", "count": 40}},
        "record_types": [
            {"type": "Load", "entity": "Load", "weight": 0.7, "tags": ["load"], "fields": [{"name": "Haulier", "kind": "entity", "ref": "Haulier"}, {"name": "Weight", "kind": "int", "min": 5, "max": 900}, {"name": "Arrival", "kind": "date", "years": [2025]}]},
            {"type": "Freight Bill", "title": "Freight Bill {entity}", "entity": "Haulier", "weight": 0.3, "fields": [{"name": "Amount", "kind": "money", "min": 10, "max": 5000}, {"name": "Status", "kind": "choice", "values": ["open", "paid"]}, {"name": "Discount", "kind": "percent", "max": 9}]},
        ],
    }
    return generators.profile_records(spark, profile, table(spark, sf_dir, "orders").count())


def invoice_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices, whose titles have a customer, a month and a year."""
    e = order_entries(spark, sf_dir, F.date_format("o_orderdate", "MMM yyyy").alias("when"))
    return e.withColumn("id", F.concat(F.lit("Invoice "), fx.field("fields", "Customer"), F.lit(" "), "when"))


@query(f"""WITH {E_SQL}, i AS (SELECT customer, strftime(o_orderdate, '%b %Y') AS w, {MONEY} AS money, status FROM e JOIN orders ON pos = o_orderkey)
  SELECT 'What is the amount of the invoice of ' || customer || ' for ' || w || '?' AS instruction, '' AS input, 'The invoice of ' || customer || ' for ' || w || ' comes to an amount of ' || money || '; its status is ' || status || '.' AS output FROM i UNION ALL
  SELECT 'Which status has the invoice of ' || customer || ' for ' || w || '?', '', 'The status of this invoice is ' || status || '.' FROM i""")
def scl30_training(spark, sf_dir):
    return generators.training_pairs(invoice_entries(spark, sf_dir))


@query()
def scl31_style(spark, sf_dir):
    return generators.style_pairs(invoice_entries(spark, sf_dir), {"status": "state", "amount": "value"}, "{summary}\nSource: {source}")


_DRAWN = lambda purpose: f"CAST('0x' || substr(md5('42|{purpose}|' || pos), 1, 10) AS BIGINT) / 1099511627776"


@query(f"""WITH p AS (SELECT o_orderkey AS pos, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () - 1 AS last FROM orders),
  m AS (SELECT *, greatest(n - 40, 0) AS low, least(n + 40, last) - greatest(n - 40, 0) AS m FROM p),
  a AS (SELECT *, CAST(floor({_DRAWN('near1')} * m) AS BIGINT) AS a, CAST(floor({_DRAWN('near2')} * (m - 1)) AS BIGINT) AS b0, least(CAST(floor({_DRAWN('others')} * 3) AS BIGINT), m) AS want FROM m),
  b AS (SELECT *, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM a),
  c AS (SELECT pos, CASE WHEN want >= 1 THEN low + a + CASE WHEN low + a >= n THEN 1 ELSE 0 END END AS x, CASE WHEN want >= 2 THEN low + b + CASE WHEN low + b >= n THEN 1 ELSE 0 END END AS y FROM b)
  SELECT c.pos, coalesce(s.pos, -1) AS near1, coalesce(t.pos, -1) AS near2 FROM c LEFT JOIN p s ON s.n = x LEFT JOIN p t ON t.n = y""")
def scl31_neighbours(spark, sf_dir):
    """The records that stand with each order in its training context."""
    return generators.neighbours(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"))).na.fill(-1)


@query("""SELECT query_id, operation, 'Amount' AS field, status, CAST(bound AS DECIMAL(38,2)) AS bound, below, lower(replace(c_name, '#', '_')) AS entity FROM (
  SELECT 2 * o_orderkey AS query_id, 'sum' AS operation, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'paid' ELSE 'confirmed' END AS status, NULL AS bound, false AS below FROM orders UNION ALL
  SELECT 2 * o_orderkey + 1, 'max', NULL, NULL, CAST(o_totalprice AS DECIMAL(18,2)), o_orderkey % 2 = 1 FROM orders) LEFT JOIN customer ON c_custkey = o_custkey""")
def scl08_questions(spark, sf_dir):
    """Two questions about each order, read by the rules."""
    o = order_entries(spark, sf_dir).select("pos", fx.field("fields", "Customer").alias("c"), fx.field("fields", "Status").alias("s"), fx.amount(fx.field("fields", "Amount")).cast("string").alias("a"))
    one = F.concat(F.lit("What is the total amount of all "), "s", F.lit(" orders of "), "c", F.lit("?"))
    two = F.concat(F.lit("What is the highest amount "), F.when(F.col("pos") % 2 == 1, "below $").otherwise("over "), "a", F.lit("?"))
    both = F.array(F.struct((2 * F.col("pos")).alias("query_id"), one.alias("question")), F.struct((2 * F.col("pos") + 1).alias("query_id"), two.alias("question")))
    asked = o.select(F.explode(both).alias("q")).select("q.query_id", "q.question")  # an order is rendered once
    return qx.parse(asked).select("query_id", "operation", "field", "status", "bound", "below", "entity")


_WORDS = "SELECT item_id, w, CAST(generate_subscripts(w, 1) AS BIGINT) - 1 AS i, unnest(w) AS x FROM (SELECT item_id, string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark)"


@query(f"WITH t AS ({_WORDS}), d AS (SELECT item_id, x, md5('42|' || item_id || '|' || i) AS d FROM t) SELECT item_id, string_agg(x, ' ' ORDER BY d) AS text FROM d GROUP BY 1")
def scl25_shuffled(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", generators.shuffled(F.trim(F.col("text")), "item_id").alias("text"))


@query(f"""WITH t AS ({_WORDS}), d AS (SELECT item_id, i, x, length(x) AS n, CAST('0x' || substr(md5('42|' || item_id || '|' || i), 1, 8) AS BIGINT) AS h FROM t),
  a AS (SELECT *, CAST(2 + (h // 1000) % greatest(n - 2, 1) AS INTEGER) AS k FROM d),
  s AS (SELECT item_id, i, CASE WHEN n > 3 AND h % 1000 < 600 AND NOT regexp_full_match(x, '[A-Za-z]+_[A-Za-z0-9]+|[A-Za-z]+(-[A-Za-z0-9]*[0-9][A-Za-z0-9]*)+') THEN substr(x, 1, k - 1) || substr(x, k + 1, 1) || substr(x, k, 1) || substr(x, k + 2) ELSE x END AS x FROM a)
  SELECT item_id, string_agg(x, ' ' ORDER BY i) AS text FROM s GROUP BY 1""")
def scl25_typos(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", generators.with_typos(F.trim(F.col("text")), "item_id").alias("text"))


@query()
def scl26_paraphrases(spark, sf_dir):
    """A question in other words about each order that is rendered as an invoice."""
    return generators.paraphrases(invoice_entries(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS pos, list_transform(list_zip(q.b, v.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END) AS x FROM v q, v WHERE q.vec_id % 50 = 0),
  s AS (SELECT query_id, pos, CAST(list_sum(x) AS BIGINT) AS distance, list_sum(list_concat(x[1:8], x[33:40])) AS near FROM d),
  c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near, pos) <= 100),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pos) AS rank FROM c) SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, distance FROM r WHERE rank <= 5""")
def top03_sketch(spark, sf_dir):
    """Nearest by whole vectors among the hundred nearest by two of eight bytes."""
    e = _signs(spark, sf_dir)
    q = e.where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "hv")
    return search.sketch_top_k(e, q, 5, candidates=100, every=4, bits=64).select("query_id", "rank", "pos", "distance")
