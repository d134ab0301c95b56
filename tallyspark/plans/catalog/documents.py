"""Chunks, ranking and answer gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import retrieval
from tallyspark.plans.catalog.registry import query, rounded, table

QUESTION = "What is there in the nation, and who does the leading thing?"
_TERMS = "[" + ", ".join(f"'{t}'" for t in retrieval.terms(QUESTION)) + "]"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _chunks_sql(source: str, keys: str) -> str:
    """Texts without blank lines are one paragraph each."""
    return rf"""d AS (SELECT {keys}, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {source}),
w AS (SELECT {keys}, unnest(range(0, length(t), 1000)) AS s, t FROM d WHERE length(t) > 1200),
c AS (SELECT {keys}, s // 1000 AS piece, substr(t, s + 1, 1200) AS text FROM w WHERE length(substr(t, s + 1, 1200)) >= 20
  UNION ALL SELECT {keys}, 0, t FROM d WHERE length(t) BETWEEN 20 AND 1200)"""


@query("chunks", f"""WITH {_chunks_sql('documents', 'doc_id')}
SELECT doc_id || '_c' || lpad((piece + 1)::VARCHAR, 5, '0') AS chunk_id, doc_id::VARCHAR AS dataset_id, piece + 1 AS position,
  length(text) AS n_chars, md5(text) AS digest FROM c""")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.chunk_texts(_docs(spark, folder), "doc_id").select(
        "chunk_id", "dataset_id", "position", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias(
            "digest")))


@query("chunk_positions", f"""WITH {_chunks_sql('conversations', 'conv_id, turn')},
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, piece) AS position FROM c)
SELECT conv_id || '_c' || lpad(position::VARCHAR, 5, '0') AS chunk_id, conv_id::VARCHAR AS dataset_id, position,
  'turn ' || turn AS locator, md5(text) AS digest FROM p""")
def chunk_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as the units of a conversation, numbered densely through it."""
    units = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("dataset_id"), F.col("turn").alias("unit"), F.concat(F.lit("turn "), F.col("turn").cast(
            "string")).alias("locator"), "text")
    return retrieval.chunk(units).select("chunk_id", "dataset_id", "position", "locator", F.md5(F.col("text").cast(
        "binary")).alias("digest"))


@query("corpus_mode", """SELECT sum(length(text)) AS chars, CASE WHEN sum(length(text)) <= 300000 THEN 'whole' ELSE 'retrieve' END AS mode
FROM documents""")
def corpus_mode(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.corpus_mode(_docs(spark, folder))


@query("token_counts", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t""")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = text.tokens(F.col("text"))
    return rounded(_docs(spark, folder).select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias(
        "n_distinct")))


@query("numerals", r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?%?'), ' ') AS numerals FROM documents""")
def numerals(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.array_join(text.numerals(F.col("text")), " ").alias("numerals"))


_BM25 = f"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
f AS (SELECT doc_id, len(w) AS dl, u.term, len(list_filter(w, lambda x: x = u.term)) AS tf FROM t, unnest({_TERMS}) AS u(term)),
q AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS score
  FROM f JOIN q USING (term), n WHERE tf > 0 GROUP BY 1 HAVING score > 0)"""


@query("bm25", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.bm25(_docs(spark, folder), QUESTION, "doc_id"), 6)


@query("bm25_top", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 8")
def bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.top_k(retrieval.bm25(_docs(spark, folder), QUESTION, "doc_id"), key="doc_id"), 6)


_EMBED = r"""src AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{question}'),
wd AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM src),
pd AS (SELECT doc_id, '#' || w || '#' AS p, length(w) AS n FROM wd),
gr AS (SELECT doc_id, md5(substr(p, i::INT, 3)) AS m FROM (SELECT doc_id, p, unnest(range(1, n + 1)) AS i FROM pd)),
vt AS (SELECT doc_id, ('0x' || substr(m, 1, 2))::INT AS bucket, 1 - 2 * (('0x' || substr(m, 10, 1))::INT % 2) AS sign FROM gr),
sm AS (SELECT doc_id, bucket, sum(sign)::DOUBLE AS w FROM vt GROUP BY 1, 2),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM sm GROUP BY 1),
em AS (SELECT doc_id, bucket, w / norm AS w FROM sm JOIN nm USING (doc_id) WHERE norm > 0)""".format(
    question=QUESTION.replace("'", "''"))


@query("bm25_sources", f"""WITH {_BM25}, top AS (SELECT * FROM bm ORDER BY bm.score DESC, doc_id LIMIT 8)
SELECT doc_id, source, lang, text, round(top.score, 6) AS score FROM top JOIN documents USING (doc_id)""")
def bm25_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The best texts with where they come from and what they say."""
    docs = _docs(spark, folder)
    best = retrieval.top_k(retrieval.bm25(docs, QUESTION, "doc_id"), key="doc_id")
    return rounded(retrieval.sourced(best, docs, "source", "lang", "text", key="doc_id"), 6)


@query("hash_embed", f"WITH {_EMBED} SELECT doc_id, bucket, round(w, 6) AS weight FROM em WHERE w <> 0 AND doc_id >= 0")
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    e = retrieval.embed(_docs(spark, folder), "doc_id")
    slots = e.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return rounded(slots, 6)


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a table of finished ones does not list yet."""
    return retrieval.missing_embeddings(_docs(spark, folder), table(spark, folder, "labels"), "doc_id").select("doc_id")


@query("cosine_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q
ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 8""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id = 0").first()["embedding"]  # one vector
    return rounded(retrieval.top_k(retrieval.cosine(vectors, asked, "vec_id"), key="vec_id"), 6)


@query("hybrid_topk", f"""WITH {_BM25}, {_EMBED},
cs AS (SELECT e.doc_id, sum(e.w * q.w) AS score FROM em e JOIN em q ON q.doc_id = -1 AND q.bucket = e.bucket WHERE e.doc_id >= 0 GROUP BY 1),
ca AS (SELECT doc_id, coalesce(score, 0) AS score FROM documents LEFT JOIN cs USING (doc_id)),
b1 AS (SELECT doc_id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS w FROM bm),
c1 AS (SELECT doc_id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS v FROM ca),
u AS (SELECT doc_id, coalesce(w, 0) AS w, coalesce(v, 0) AS v FROM b1 FULL JOIN c1 USING (doc_id))
SELECT doc_id, round(w, 6) AS word_score, round(v, 6) AS vector_score, round(0.5 * w + 0.5 * v, 6) AS score FROM u
ORDER BY 0.5 * w + 0.5 * v DESC, doc_id LIMIT 8""")
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return rounded(retrieval.hybrid_texts(docs, QUESTION, key="doc_id"), 6)


_STEMS = "[" + ", ".join(f"'{s}'" for s in retrieval._asked_stems(QUESTION, True)) + "]"
_PLAIN = "[" + ", ".join(f"'{s}'" for s in retrieval._asked_stems(QUESTION, False)) + "]"
_STOP = "[" + ", ".join(f"'{s}'" for s in text.STOP_WORDS) + "]"


@query("evidence_preview", f"""WITH t AS (SELECT doc_id, text, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: left(x, 5))) AS s FROM documents)
SELECT doc_id, len(list_intersect(s, {_PLAIN})) AS overlap, substr(text, 1, 150) AS excerpt FROM t ORDER BY overlap DESC, doc_id LIMIT 2""")
def evidence_preview(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.preview(_docs(spark, folder), QUESTION, key="doc_id"))


@query("extractive_answer", rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t,
  list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)), lambda x: left(x, 5))) AS s FROM documents),
b AS (SELECT doc_id, t, len(list_intersect(s, {_STEMS})) AS overlap FROM t)
SELECT doc_id, overlap, CASE WHEN length(t) > 220 THEN regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') || '...' ELSE t END AS snippet
FROM b WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 3""")
def extractive_answer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.extractive_answer(_docs(spark, folder), QUESTION, key="doc_id"))


@query("citation_gate", """
SELECT a.conv_id || '_' || a.turn AS claim_id, count(*) FILTER (e.role = 'user') = count(*) AS accepted FROM conversations a
JOIN conversations e ON e.conv_id = a.conv_id AND e.turn < a.turn AND e.turn >= a.turn - 2 WHERE a.role = 'assistant' GROUP BY 1
UNION ALL SELECT conv_id || '_' || turn, false FROM conversations WHERE role = 'assistant' AND turn = 0""")
def citation_gate(spark: SparkSession, folder: str) -> DataFrame:
    """An answer cites the two turns before it; only users' turns were supplied."""
    talk = table(spark, folder, "conversations").withColumn("chunk_id", F.concat_ws("_", "conv_id", "turn"))
    earlier = F.transform(F.filter(F.array(F.col("turn") - 1, F.col("turn") - 2), lambda t: t >= 0),
                          lambda t: F.concat_ws("_", F.col("conv_id").cast("string"), t.cast("string")))
    claims = talk.where("role = 'assistant'").select(F.col("chunk_id").alias("claim_id"), "text", earlier.alias("evidence"))
    return retrieval.citation_gate(claims, talk.where("role = 'user'")).select("claim_id", "accepted")


@query("number_gate", """SELECT c_custkey AS claim_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS unsupported_count,
  c_mktsegment <> 'MACHINERY' AS passed FROM customer""")
def number_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Claims about balances; in one segment they are off by one."""
    who = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_mktsegment") == "MACHINERY", F.round(F.col("c_acctbal") + 1, 2)).otherwise(F.col("c_acctbal"))
    claims = who.select(F.col("c_custkey").alias("claim_id"), F.concat(
        F.lit("Customer "), key, F.lit(" has "), said.cast("decimal(18,2)").cast("string"), F.lit(".")).alias("text"),
        F.array("c_custkey").alias("evidence"))
    facts = who.select(F.col("c_custkey").alias("chunk_id"), F.format_string(
        "Account of customer %d: balance $%,.2f.", "c_custkey", "c_acctbal").alias("text"))
    return retrieval.number_gate(claims, facts).select("claim_id", "unsupported_count", "passed")


@query("narrative_numbers", """SELECT '987654321' AS raw FROM orders HAVING count(*) <> 987654321""")
def narrative_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """A narrative with the true row count and an invented number."""
    facts = table(spark, folder, "orders").agg(F.format_string(
        "%,d rows, %.2f in total", F.count(F.lit(1)), F.sum("o_totalprice")).alias("fact"))
    told = table(spark, folder, "orders").agg(F.concat(
        F.lit("There are "), F.count(F.lit(1)).cast("string"), F.lit(" orders and 987654321 wishes.")).alias("text"))
    return retrieval.unverified_numbers(told, facts)
