"""Row rules, masking, share scopes and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.model import ColumnMeta, Dataset
from tallyspark.operators import governance, profile, security, slices
from tallyspark.operators.security import RowRule, Share
from tallyspark.plans.catalog.registry import ORDERS, SALES, orders, query, rounded, sales, table


@query("row_rules", f"""WITH {SALES} SELECT r_name, o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS value FROM s
WHERE (r_name IN ('ASIA') OR r_name IN ('EUROPE')) AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def row_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Two rules on one column widen each other; a rule on another narrows."""
    ds = security.secure(sales(spark, folder), [RowRule("r_name", ["ASIA"]), RowRule("r_name", ["EUROPE"]),
                                                RowRule("o_orderstatus", ["F", "O"])])
    return rounded(ds.frame.groupBy("r_name", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("value")))


@query("row_rules_not_in", f"""WITH {ORDERS} SELECT o_orderpriority, count(*) AS n_rows FROM o
WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderpriority IS NULL GROUP BY 1""")
def row_rules_not_in(spark: SparkSession, folder: str) -> DataFrame:
    ds = security.secure(orders(spark, folder), [RowRule("o_orderpriority", ["1-URGENT", "5-LOW"], "not_in")])
    return ds.frame.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))


@query("row_rules_deny", "SELECT count(*) AS n_rows FROM orders WHERE 1 = 0")
def row_rules_deny(spark: SparkSession, folder: str) -> DataFrame:
    """A rule on a column that is gone grants nothing."""
    ds = security.secure(orders(spark, folder), [RowRule("region", ["North"]), RowRule("o_orderstatus", ["F"])])
    return ds.frame.agg(F.count(F.lit(1)).alias("n_rows"))


@query("row_rules_long_list", """SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS value FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def row_rules_long_list(spark: SparkSession, folder: str) -> DataFrame:
    """Rules given as a table: the facts are semi-joined with it."""
    listed = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("o_custkey"))
    kept = security.apply_listed(orders(spark, folder), "o_custkey", listed)
    return rounded(slices.slice_value(kept).select("n_rows", "value"))


def _people(spark: SparkSession, folder: str) -> Dataset:
    who = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("customer_name"), "c_mktsegment", "c_acctbal",
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com")).alias(
            "contact"),
        F.concat(F.lit("98765"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("reach"),
        F.concat(F.lit("1234567"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("card"))
    return Dataset.open(who, [ColumnMeta("c_custkey", "ignored"), ColumnMeta("customer_name", "ignored"),
                              ColumnMeta("c_mktsegment", "dimension", "business_unit", 5),
                              ColumnMeta("c_acctbal", "measure", "count"), ColumnMeta("contact", "ignored"),
                              ColumnMeta("reach", "ignored"), ColumnMeta("card", "ignored")], "people")


_PEOPLE = """w AS (SELECT c_custkey, c_name AS customer_name, c_mktsegment, c_acctbal,
  lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com' AS contact,
  '98765' || lpad(c_custkey::VARCHAR, 5, '0') AS reach, '1234567' || lpad(c_custkey::VARCHAR, 5, '0') AS card FROM customer)"""


@query("masked_projection", f"""WITH {_PEOPLE}
SELECT c_custkey, substr(customer_name, 1, 1) || '*****' AS customer_name, c_mktsegment, c_acctbal,
  substr(contact, 1, 2) || '***@' || split_part(contact, '@', 2) AS contact, '******' || right(reach, 4) AS reach,
  '********' || right(card, 4) AS card FROM w""")
def masked_projection(spark: SparkSession, folder: str) -> DataFrame:
    masks = {"customer_name": "person_name", "contact": "email", "reach": "phone", "card": "national_id", "gone": "email"}
    return security.secure(_people(spark, folder), (), masks).frame


@query("secured_slice", f"""WITH {_PEOPLE}, m AS (SELECT *, '******' || right(reach, 4) AS hidden FROM w WHERE c_mktsegment = 'BUILDING')
SELECT hidden AS reach, count(*) AS n_rows, round(sum(c_acctbal), 2) AS value FROM m GROUP BY 1""")
def secured_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The rule sees the raw segment; grouping sees the masked number."""
    ds = security.secure(_people(spark, folder), [RowRule("c_mktsegment", ["BUILDING"])], {"reach": "phone"})
    return rounded(slices.value_by(ds.frame, ["reach"], "c_acctbal", "sum").select("reach", "n_rows", "value"))


@query("share_scope", f"""WITH {SALES} SELECT round(sum(o_totalprice), 2) AS value, count(*) AS n_rows FROM s
WHERE r_name = 'ASIA' AND o_orderstatus = 'F' AND o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'""")
def share_scope(spark: SparkSession, folder: str) -> DataFrame:
    """A visitor narrows by status and asks for more years than the link shares."""
    share = Share({"r_name": "ASIA"}, "1998-01", "1998-12")
    ds = share.open(sales(spark, folder), {"o_orderstatus": "F"}, "1995-01", "2001-12")
    return rounded(slices.slice_value(ds))


@query("pii_detect", """SELECT * FROM (VALUES ('customer_name', 'person_name'), ('contact', 'email'), ('reach', 'phone'),
  ('card', 'national_id')) AS t("column", kind), (SELECT count(*) AS n FROM customer) WHERE n >= 5""")
def pii_detect(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder)
    n = people.frame.agg(F.count(F.lit(1))).scalar()
    return profile.detect_pii(people.frame).withColumn("n", n)


@query("pii_share_in_texts", r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS v FROM documents)
SELECT count(*) FILTER (regexp_full_match(v, '(?i)[^@\s]+@[^@\s]+\.[a-z]{2,}')) AS emails,
  count(*) FILTER (regexp_full_match(v, '[0-9]{12}')) AS national_ids,
  count(DISTINCT doc_id) FILTER (regexp_full_match(v, '(?i)[^@\s]+@[^@\s]+\.[a-z]{2,}')) AS texts_with_email FROM w""")
def pii_share_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The value shapes over every word of every text."""
    w = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("v"))
    email = F.col("v").rlike(profile.EMAIL_SHAPE)
    return w.agg(F.count_if(email).alias("emails"), F.count_if(F.col("v").rlike(profile.TWELVE_DIGITS)).alias(
        "national_ids"), F.count_distinct(F.when(email, F.col("doc_id"))).alias("texts_with_email"))


@query("log_redaction_nested", r"""SELECT doc_id, lang, '[redacted]' AS "session", 'Bearer [redacted], ' || lang AS "first_call", '[redacted]' AS "call_token",
  NULL AS "cookies", source AS "plain", doc_id AS "number" FROM documents""")
def log_redaction_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes with a struct of a map of lists of maps: secrets at every depth."""
    call = F.create_map(F.lit("header"), F.concat(F.lit("Bearer "), F.md5(F.col("text").cast("binary")), F.lit(", "), F.col("lang")),
                        F.lit("x-api-key"), F.md5(F.col("text").cast("binary")))
    extra = F.struct("lang", F.col("source").alias("session_id"), F.array("source").alias("cookies"), F.col("doc_id").alias("number"),
                     F.create_map(F.lit("calls"), F.array(call, call), F.lit("plain"), F.array(F.create_map(F.lit("source"), F.col("source")))).alias("more"))
    log = governance.redact_log(table(spark, folder, "documents").select("doc_id", F.lit("").alias("line"), extra.alias("extra")), "line", "extra")
    calls = F.col("extra.more")["calls"][1]
    return log.select("doc_id", "extra.lang", F.col("extra.session_id").alias("session"), calls["header"].alias("first_call"), calls["x-api-key"].alias("call_token"),
                      F.col("extra.cookies")[0].alias("cookies"), F.col("extra.more")["plain"][0]["source"].alias("plain"), "extra.number")


@query("log_redaction", r"""
WITH l AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'Authorization: Bearer ' || md5(text) || '.x' ELSE text END AS line,
  md5(text) AS t FROM documents)
SELECT doc_id, regexp_replace(line, '(Bearer\s+)[A-Za-z0-9._\-]+', '\1[redacted]', 'gi') AS line, '[redacted]' AS api_key,
  lang_value AS lang FROM (SELECT l.*, d.lang AS lang_value FROM l JOIN documents d USING (doc_id))""")
def log_redaction(spark: SparkSession, folder: str) -> DataFrame:

    docs = table(spark, folder, "documents")
    line = F.when(F.col("source") == "src0", F.concat(F.lit("Authorization: Bearer "), F.md5(F.col("text").cast("binary")),
                                                      F.lit(".x"))).otherwise(F.col("text"))
    log = docs.select("doc_id", line.alias("line"), F.create_map(
        F.lit("api_key"), F.md5(F.col("text").cast("binary")), F.lit("lang"), F.col("lang")).alias("extra"))
    out = governance.redact_log(log, "line", "extra")
    return out.select("doc_id", "line", F.col("extra")["api_key"].alias("api_key"), F.col("extra")["lang"].alias("lang"))


@query("row_hash", r"""
SELECT doc_id, md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(lang, chr(0)) || chr(31) || coalesce(source, chr(0))) AS h
FROM documents""")
def row_hash(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit("\x00")
    parts = [F.coalesce(F.col(c).cast("string"), none) for c in ("doc_id", "lang", "source")]
    return table(spark, folder, "documents").select("doc_id", F.md5(F.concat_ws("\x1f", *parts).cast("binary")).alias("h"))


