"""Text rendered from the star schema, on which fact operators, the judge's parser and the decision rules have something to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.inputs import spread, table

#: Orders whose sentences a task makes and reads: a file of orders is small for the work that they are.
ORDERS_A_PART = 100_000


def picked(values: list, number: Column) -> Column:
    """values[number modulo their count]."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and raw: a judge's reply for each order, in good form or with fields repeated, missing, decorated or indented."""
    key, claim = F.col("id"), F.col("claim")
    forms = [
        F.concat(F.lit("REASONING: "), claim, F.lit("\nmore\nVERDICT: HALLUCINATED\nCONFIDENCE: HIGH\nCORRECTION: "), F.col("source")),
        F.concat(F.lit("VERDICT: SUPPORTED\nVERDICT: HALLUCINATED\nREASONING:"), claim),
        F.concat(F.lit("**VERDICT:** HALLUCINATED\n VERDICT: [HALLUCINATED]\n"), claim),
        F.concat(F.lit("  CONFIDENCE: LOW \nCORRECTION: CORRECTION: "), claim, F.lit("\n VERDICT: SUPPORTED  ")),
        F.lit(""),
    ]
    raw = F.when(key % 5 == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        raw = raw.when(key % 5 == k, form)
    return rendered(spark, sf_dir).select("id", raw.alias("raw"))


REPLIES_SQL = """replies AS (SELECT id, CASE id % 5
  WHEN 0 THEN 'REASONING: ' || claim || chr(10) || 'more' || chr(10) || 'VERDICT: HALLUCINATED' || chr(10) || 'CONFIDENCE: HIGH' || chr(10) || 'CORRECTION: ' || source
  WHEN 1 THEN 'VERDICT: SUPPORTED' || chr(10) || 'VERDICT: HALLUCINATED' || chr(10) || 'REASONING:' || claim
  WHEN 2 THEN '**VERDICT:** HALLUCINATED' || chr(10) || ' VERDICT: [HALLUCINATED]' || chr(10) || claim
  WHEN 3 THEN '  CONFIDENCE: LOW ' || chr(10) || 'CORRECTION: CORRECTION: ' || claim || chr(10) || ' VERDICT: SUPPORTED  '
  ELSE '' END AS raw FROM rendered)"""

LABELS, LEVELS, JUDGED = ["ENTAILMENT", "CONTRADICTION", "NEUTRAL"], ["0.5", "0.84", "0.85", "0.92"], ["none", "HALLUCINATED", "SUPPORTED", "UNKNOWN"]


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, nli_label, nli_score, points, signals and j for each order: by its key all labels, scores around the cuts, fact points and judge's results."""
    key = F.col("o_orderkey")
    points = F.floor(key / 12) % 21 * 5
    signals = F.when(points > 0, F.array(F.lit("one"), F.lit("two"), F.lit("three"))).otherwise(F.array().cast("array<string>"))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), ORDERS_A_PART)
    return rows.select(key.cast("string").alias("id"), picked(LABELS, key).alias("nli_label"), picked(LEVELS, F.floor(key / 3)).cast("double").alias("nli_score"), points.cast("int").alias("points"), signals.alias("signals"), picked(JUDGED, F.floor(key / 252)).alias("j"))


DECISIONS_SQL = (
    "grid AS (SELECT CAST(k AS VARCHAR) AS id, ['ENTAILMENT', 'CONTRADICTION', 'NEUTRAL'][k % 3 + 1] AS nli_label, CAST(['0.5', '0.84', '0.85', '0.92'][k // 3 % 4 + 1] AS DOUBLE) AS nli_score, CAST(k // 12 % 21 * 5 AS INTEGER) AS points, "
    "CASE WHEN k // 12 % 21 > 0 THEN ['one', 'two', 'three'] ELSE [] END AS signals, 'e' AS evidence, CASE WHEN j = 'none' THEN 0 ELSE 1 END AS judged, j AS llm_verdict, CASE WHEN j = 'UNKNOWN' THEN '' ELSE 'why' END AS reasoning, 'LOW' AS confidence, 'fix' AS correction "
    "FROM (SELECT o_orderkey AS k, ['none', 'HALLUCINATED', 'SUPPORTED', 'UNKNOWN'][o_orderkey // 252 % 4 + 1] AS j FROM orders))"
)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, claim: a sentence of each order, and the same with deterministic changes."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ORDERS_A_PART)
    key = F.col("o_orderkey")
    percent, year = (key % 90 + 1).cast("string"), F.year("o_orderdate")
    n = (key % 50 + 2).cast("string")
    says = lambda p, y, c, org, word: F.concat(F.lit("In "), y.cast("string"), F.lit(" the "), org, F.lit(" said "), p, F.lit("% of patients in "), c, F.lit(" countries"), word, F.lit(" recovered."))
    org = F.lit("World Health Organization")
    source = says(percent, year, n, org, F.lit(""))
    claim = says(
        F.when(key % 2 == 0, percent).otherwise((key % 90 + 2).cast("string")),
        F.when(key % 3 == 0, F.lit(1875)).otherwise(year + F.when(key % 5 == 0, 10).otherwise(0)),
        F.when(key % 7 == 0, (key % 50 + 3).cast("string")).otherwise(n),
        F.when(key % 11 == 0, F.lit("World Trade Organization")).otherwise(org),
        F.when(key % 13 == 0, F.lit(" always")).otherwise(F.lit("")),
    )
    return o.select(key.alias("id"), source.alias("source"), claim.alias("claim"))


RENDERED_SQL = """rendered AS (
  SELECT k AS id,
    'In ' || y || ' the World Health Organization said ' || p || '% of patients in ' || n || ' countries recovered.' AS source,
    'In ' || CASE WHEN k % 3 = 0 THEN 1875 ELSE y + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END END || ' the ' ||
    CASE WHEN k % 11 = 0 THEN 'World Trade Organization' ELSE 'World Health Organization' END || ' said ' ||
    CASE WHEN k % 2 = 0 THEN p ELSE p + 1 END || '% of patients in ' || CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END || ' countries' ||
    CASE WHEN k % 13 = 0 THEN ' always' ELSE '' END || ' recovered.' AS claim
  FROM (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderkey % 90 + 1 AS p, o_orderkey % 50 + 2 AS n FROM orders)
)"""
