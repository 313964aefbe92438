"""The whole verification as one lazy plan, from documents and responses to verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import facts, text
from attestor.operators import models, passages, retrieval
from attestor.operators.verdict import needs_judge, verdict
from attestor.sources.store import ChunkStore

Provider = Callable[[DataFrame], DataFrame]


@dataclass
class Providers:
    """Where scores come from: semantic(claims, chunks), by default the cosine of token counts; entailment(hits); judge(gated)."""

    semantic: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    entailment: Provider = models.entailment_by_overlap
    judge: Provider = models.judge_by_rule


@dataclass
class Options:
    """claim_limit and organization_limit may be None: then all claims of a response count, all organizations of a text."""

    top_k: int = retrieval.TOP_K
    claim_limit: int | None = text.CLAIM_LIMIT
    organization_limit: int | None = facts.ORGANIZATIONS_MOST
    full_years: bool = False
    case_sensitive_labels: bool = False


def hits(docs: DataFrame, responses: DataFrame, claims: DataFrame, providers: Providers, options: Options) -> DataFrame:
    return retrieval.hybrid(claims, _own_lists(docs, responses), options.top_k, providers.semantic)


def _own_lists(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunk lists of the documents that have responses: claims needn't be made to tell which these are."""
    return passages.chunk_lists(docs.join(responses.select("doc_id").distinct(), "doc_id", "left_semi"))


def checked(found: DataFrame, providers: Providers, options: Options) -> DataFrame:
    """One row a claim: best evidence, fact comparison with the retrieved context, and whether the judge is needed.

    Hits are dealt out by claim once: what follows is grouped and joined where they lie.
    """
    found = found.repartition(*models.CLAIM)
    scored = providers.entailment(models.first_rank(found))
    best = models.best_evidence(scored, options.case_sensitive_labels)
    context = retrieval.contexts(found).select(*models.CLAIM, "parents", "context")
    rows = best.join(context, models.CLAIM)
    rows = rows.withColumn("own_facts", facts.facts(F.col("claim"), options.full_years, facts.OF_CLAIM, options.organization_limit)).withColumn("source_facts", facts.facts(F.col("context"), options.full_years, facts.OF_SOURCE))
    rows = rows.withColumn("compared", facts.compared(F.col("own_facts"), F.col("source_facts"), F.col("context")))
    rows = rows.withColumn("points", F.col("compared.points")).withColumn("signals", F.col("compared.signals"))
    return rows.withColumn("needs_judge", needs_judge(F.col("nli_label"), F.col("nli_score"), F.col("points"))).drop("compared", "own_facts", "source_facts", "context")


def _with_judge(rows: DataFrame, judge: Provider) -> DataFrame:
    """rows with was_judged and the fields of the judge's reply, null where the judge isn't needed.

    The default judge is an expression, so it is one more projection; any other sees the gated rows alone and is joined.
    """
    if judge is models.judge_by_rule:
        replied = rows.withColumn("raw", F.when(F.col("needs_judge"), models.rule_reply()))
        return replied.select(*rows.columns, F.col("needs_judge").alias("was_judged"), *models.parsed_reply(F.col("raw")))
    judged = models.judged(rows.where("needs_judge"), judge)
    return rows.join(judged.drop("llm_raw").withColumn("was_judged", F.lit(True)), models.CLAIM, "left")


def verify(docs: DataFrame, responses: DataFrame, providers: Providers | None = None, options: Options | None = None) -> DataFrame:
    """Verdicts of the claims of responses(response_id, doc_id, text) against docs(doc_id, text).

    A claim whose document is missing or has no sentence is Uncertain, without evidence.
    """
    options = options or Options()
    claims = passages.claims(responses, options.claim_limit)
    return _verdicts(_own_lists(docs, responses), claims, providers or Providers(), options)


def verify_stored(store: ChunkStore, docs: DataFrame, responses: DataFrame, providers: Providers | None = None, options: Options | None = None, embedder: retrieval.Embedder | None = None) -> DataFrame:
    """verify() on the store's index: documents that aren't stored yet are added first, stored ones aren't split or counted again.

    doc_id is text on both sides, and should name a document's content. With an embedder, new chunks are stored with their
    vectors, and semantic scores are cosines of these with the claims' vectors.
    """
    docs, responses = (x.withColumn("doc_id", F.col("doc_id").cast("string")) for x in (docs, responses))
    fresh = passages.chunks(store.missing(docs))
    store.upsert(embedder(fresh, "text") if embedder else fresh)
    if embedder:
        providers = replace(providers or Providers(), semantic=embedder.semantic)
    options = options or Options()
    claims = passages.claims(responses, options.claim_limit)
    return _verdicts(store.index(claims), claims, providers or Providers(), options)


def _verdicts(docs: DataFrame | retrieval.Index, claims: DataFrame, providers: Providers, options: Options) -> DataFrame:
    return verdicts_of(claims, checked(retrieval.hybrid(claims, docs, options.top_k, providers.semantic), providers, options), providers)


def verdicts_of(claims: DataFrame, rows: DataFrame, providers: Providers) -> DataFrame:
    """Verdicts of all claims, from the rows of checked() for those that have any."""
    rows = claims.join(_with_judge(rows, providers.judge).drop("claim"), models.CLAIM, "left")
    none = F.array().cast("array<string>")
    given = verdict(
        F.coalesce("nli_label", F.lit("NEUTRAL")),
        F.coalesce("nli_score", F.lit(0.0)),
        F.coalesce("evidence", F.lit("")),
        F.coalesce("points", F.lit(0)),
        F.coalesce("signals", none),
        F.coalesce("was_judged", F.lit(False)),
        F.col("llm_verdict"),
        F.col("reasoning"),
        F.col("confidence"),
        F.col("correction"),
    )
    kept = [*models.CLAIM, "claim", F.coalesce("nli_label", F.lit("NEUTRAL")).alias("nli_label"), F.coalesce("nli_score", F.lit(0.0)).alias("nli_score"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("needs_judge", F.lit(False)).alias("needs_judge")]
    return rows.withColumn("given", given).select(*kept, "given.*")
