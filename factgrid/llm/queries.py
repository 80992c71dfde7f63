"""The registered ``opN_*`` queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    from .bpe import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"), vocabulary())


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 2-word shingle sets at Jaccard 0.8."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.98."""
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector against all others."""
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows not held out."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query
def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of ``op6_pii``, which SQL can express."""
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


@query
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and filter-model scores of every document."""
    from .lm import by_seventh, score_texts

    return score_texts(table(spark, sf_dir, "documents"), by_seventh())


@query
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of earlier documents."""
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with the piece vocabulary and decode it."""
    from .pieces import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"), piece_model())


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of ``op13_whitening``, which SQL can express."""
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation")


_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_REACH = """, r AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)"""

ORACLE_SQL["op1_minhash"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)){_REACH},
  m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"""

ORACLE_SQL["op3_embeddings"] = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98){_REACH},
  m AS (SELECT a, min(b) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
  SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
  FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT)
    ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) - CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
ORACLE_SQL["pii_base"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda y: coalesce(TRY_CAST(y AS HUGEINT), 999) > 255)) = 0)) AS n_ip,
    len(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN})) AS n_card,
    len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM d"""

ORACLE_SQL["op7_topk"] = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_VALID}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5"""

ORACLE_SQL["whitening_base"] = f"""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE {_VALID}),
  x AS (SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM v),
  p AS (SELECT row, vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM x),
  s AS (SELECT i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM p GROUP BY i),
  d AS (SELECT row, vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation, count(*) AS size FROM p JOIN s USING (i) GROUP BY row, vec_id, n)
  SELECT vec_id, CAST(unnest(range(1, least(size, 8) + 1)) AS INTEGER) AS component, n, deviation FROM d"""

_FLOOR = "CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l AS HUGEINT) + r) AS BIGINT)"
ORACLE_SQL["op12_collocations"] = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
  n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
  g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
  f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
  c AS (SELECT f.lang, f.k, f.g, f.f AS a, unnest(range(1, f.k)) AS cut FROM f WHERE f.k > 1),
  s AS (SELECT c.*, x.f AS l, y.f AS r FROM c JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.cut) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.cut + 1, c.k)),
  b AS (SELECT *, {_FLOOR} AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY {_FLOOR}, cut) = 1),
  i AS (SELECT f.lang, f.f, unnest(flatten(list_transform(range(2, f.k), lambda m: list_transform(range(1, f.k - m + 2), lambda i: list_slice(f.g, i, i + m - 1))))) AS g FROM f WHERE f.k > 2),
  o AS (SELECT lang, g, max(f) AS f FROM i GROUP BY ALL),
  k AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
  z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
  SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""
