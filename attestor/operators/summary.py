"""Summaries of verdicts by response: counts, rate, density by section, corrected text, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import normalized

SECTIONS = 5
HIGH, MID = 60, 30
# Fixed value: the report's title.
REPORT_TITLE = "VERIFICATION REPORT"


def _rate(part: Column, of: Column) -> Column:
    return F.when(of > 0, F.bround(part / of * 100, 1)).otherwise(0.0)


def summaries(verdicts: DataFrame, responses: DataFrame) -> DataFrame:
    """One row for each of responses(response_id, doc_id), those without claims included."""
    count = lambda name: F.count_if(F.col("verdict") == name)
    rows = verdicts.groupBy("response_id").agg(
        F.count("*").alias("total_claims"),
        count("Hallucinated").alias("hallucinated"),
        count("Uncertain").alias("uncertain"),
        count("Supported").alias("supported"),
        F.count_if("needs_judge").alias("llm_calls_made"),
    )
    out = responses.select("response_id", "doc_id").join(rows, "response_id", "left").na.fill(0)
    rate = _rate(F.col("hallucinated"), F.col("total_claims"))
    return out.withColumn("llm_calls_saved", F.col("total_claims") - F.col("llm_calls_made")).withColumn("hallucination_rate", rate)


def densities(verdicts: DataFrame) -> DataFrame:
    """response_id, section, density, claims: a fifth of the claims a section (one claim at least), in claim order."""
    own = Window.partitionBy("response_id")
    rows = verdicts.select("response_id", "verdict", (F.row_number().over(own.orderBy("claim_no")) - 1).alias("pos"), F.count("*").over(own).alias("n"))
    section = F.floor(F.col("pos") / F.greatest(F.lit(1), F.floor(F.col("n") / SECTIONS)))
    wrong = F.count_if(F.col("verdict") == "Hallucinated")
    rows = rows.groupBy("response_id", section.alias("at")).agg(wrong.alias("wrong"), F.count("*").alias("claims"))
    return rows.select("response_id", F.concat(F.lit("S"), (F.col("at") + 1).cast("string")).alias("section"), _rate(F.col("wrong"), F.col("claims")).alias("density"), "claims")


def level(density: Column) -> Column:
    """Bucket of a density."""
    return F.when(density >= HIGH, "high").when(density >= MID, "mid").otherwise("low")


def shown(verdicts: DataFrame) -> DataFrame:
    """What a claim's card shows: label, explanation, evidence, and the correction if there is one."""
    label = F.when(F.col("verdict").isin("Hallucinated", "Uncertain"), F.upper("verdict")).otherwise("SUPPORTED")
    explanation = F.coalesce(F.nullif("explanation", F.lit("")), F.lit("High confidence verdict — explanation not required."))
    return verdicts.select("response_id", "claim_no", label.alias("label"), "hallucination_score", explanation.alias("explanation"), F.coalesce(F.nullif("evidence", F.lit("")), F.lit("N/A")).alias("evidence"), F.when(has_correction(), F.col("correction")).alias("correction"))


def has_correction() -> Column:
    return F.col("correction").isNotNull() & ~F.col("correction").isin("", "N/A")


def corrected(responses: DataFrame, verdicts: DataFrame, normalise: bool = False) -> DataFrame:
    """response_id and its text with every occurrence of each wrong claim replaced by its correction, in claim order.

    Claims are of the text with its white space made even; with normalise they are looked for there, so that a line break
    inside a claim doesn't hide it.
    """
    if normalise:
        responses = responses.withColumn("text", normalized(F.col("text")))
    wrong = verdicts.where((F.col("verdict") == "Hallucinated") & has_correction())
    fixes = wrong.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim", "correction"))).alias("fixes"))
    note = lambda fix: F.concat(F.lit("**[CORRECTED: "), fix["correction"], F.lit("]**"))
    text = F.aggregate("fixes", F.col("text"), lambda done, fix: F.replace(done, fix["claim"], note(fix)))
    return responses.join(fixes, "response_id", "left").select("response_id", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(text).alias("corrected"))


def reports(verdicts: DataFrame, summary: DataFrame) -> DataFrame:
    """response_id and the text report: a head of counts, then six lines for each claim."""
    line = lambda name, value: F.concat(F.rpad(F.lit(name), 16, " "), F.lit(": "), value.cast("string"))
    rule = F.lit("=" * 50)
    head = F.concat_ws(
        "\n",
        F.lit(REPORT_TITLE),
        rule,
        line("Doc ID", F.col("doc_id")),
        line("Total Claims", F.col("total_claims")),
        line("Hallucinated", F.col("hallucinated")),
        line("Uncertain", F.col("uncertain")),
        line("Supported", F.col("supported")),
        line("Hallucination %", F.concat(F.col("hallucination_rate").cast("string"), F.lit("%"))),
        line("Judge Calls", F.col("llm_calls_made")),
        line("Calls Saved", F.col("llm_calls_saved")),
        rule,
        F.lit("\nCLAIM-BY-CLAIM BREAKDOWN\n"),
    )
    nth = F.row_number().over(Window.partitionBy("response_id").orderBy("claim_no"))
    rows = verdicts.withColumn("nth", nth)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Claim "), F.col("nth").cast("string"), F.lit(": "), F.col("verdict"), F.lit(" (score: "), F.col("hallucination_score").cast("string"), F.lit(")")),
        F.concat(F.lit("  Text       : "), F.col("claim")),
        F.concat(F.lit("  Explanation: "), F.col("explanation")),
        F.concat(F.lit("  Evidence   : "), F.col("evidence")),
        F.concat(F.lit("  Correction : "), F.col("correction")),
        F.lit(""),
    )
    blocks = rows.select("response_id", "nth", block.alias("block")).groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    return summary.join(blocks, "response_id", "left").select("response_id", F.concat_ws("\n", head, body).alias("report"))
