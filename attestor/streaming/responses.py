"""Verification of responses as they arrive: a stream of conversation turns against stored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.operators.passages import responses
from attestor.plans.verify import Options, Providers, verify

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def verify_stream(spark: SparkSession, turns: DataFrame, docs: DataFrame, out: str, checkpoint: str, providers: Providers | None = None, options: Options | None = None):
    """Starts a query that appends the verdicts of each micro-batch of turns to Parquet in out, batch by batch.

    Retrieval ranks within a response, so batches are independent and no state or watermark is kept. A batch that is
    run again after a failure overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        verify(docs, responses(batch), providers, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return turns.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims_stream(turns: DataFrame) -> DataFrame:
    """Claims of arriving turns: a stateless projection, so it appends."""
    from attestor.operators.passages import claims

    return claims(responses(turns))
