"""Progress of running jobs, told to a callback: by finished tasks, or by the rows that each stage of a verification has made."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attestor.operators import passages, retrieval
from attestor.plans.verify import Options, Providers, checked, verdicts_of
from attestor.sources.scratch import stored


@contextmanager
def progress(spark: SparkSession, update: Callable[[str, float], None], every: float = 0.5) -> Iterator[None]:
    """Calls update(message, part done) while the block's jobs run, at a steady pace, and with 1.0 at its end.

    The part is that of finished tasks in the stages seen so far; it never falls.
    """
    tracker, stop, seen, last = spark.sparkContext.statusTracker(), threading.Event(), {}, 0.0

    def watch() -> None:
        nonlocal last
        while not stop.wait(every):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    seen[stage] = (info.numCompletedTasks, info.numTasks, info.name)
            if seen:
                done, total = (sum(x[i] for x in seen.values()) for i in (0, 1))
                last = max(last, min(0.99, done / max(1, total)))
                update(f"Stage {max(seen)}: {seen[max(seen)][2]}", last)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
    update("Done", 1.0)


def observed(rows: DataFrame, name: str, update: Callable[[str, float, int], None], part: float) -> DataFrame:
    """rows, written once; their number, as Spark observed it while they were written, is told to update."""
    seen = Observation(name)
    out = stored(rows.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    update(name, part, seen.get["rows"])
    return out


def verify_in_stages(docs: DataFrame, responses: DataFrame, update: Callable[[str, float, int], None], providers: Providers | None = None, options: Options | None = None) -> DataFrame:
    """verify() with each stage written before the next begins; update(stage, part done, rows made) is called after each.

    Stages are claims, hits, evidence and verdicts. What is written also spares a lost executor the stages before.
    """
    providers, options = providers or Providers(), options or Options()
    claims = observed(passages.claims(responses, options.claim_limit), "claims", update, 0.25)
    own = passages.chunk_lists(docs.join(claims.select("doc_id").distinct(), "doc_id", "left_semi"))
    found = observed(retrieval.hybrid(claims, own, options.top_k, providers.semantic), "hits", update, 0.5)
    rows = observed(checked(found, providers, options), "evidence", update, 0.75)
    return observed(verdicts_of(claims, rows, providers), "verdicts", update, 1.0)
