"""Model operators: providers give relations of scores, the engine never loads a model.

The defaults are deterministic stand-ins for an entailment model and a judge. They are no such models and are not
claimed to agree with one; they let every later operator run, and a real provider takes their place by giving
the same columns.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.rows import once
from attestor.sources.cache import ContentCache
from attestor.sources.scratch import scratch, stored

ENTAILMENT, CONTRADICTION, NEUTRAL = "ENTAILMENT", "CONTRADICTION", "NEUTRAL"
CLAIM = ["response_id", "doc_id", "claim_no"]

# The judge's instructions and the prefixes of its reply.
PROMPT = """You are a precise fact-checking AI. Your job is to verify if a claim is supported by the source text.

SOURCE TEXT:
{source}

CLAIM TO VERIFY:
"{claim}"

Analyze step by step:
1. What does the source say about this topic?
2. What does the claim say?
3. Do they agree or contradict?

Respond in this EXACT format:
REASONING: [your step by step analysis in 2-3 sentences]
VERDICT: [SUPPORTED or HALLUCINATED]
CONFIDENCE: [HIGH or MEDIUM or LOW]
CORRECTION: [if HALLUCINATED, write the corrected version of the claim based on source. If SUPPORTED, write "N/A"]"""
REPLY = {"reasoning": ("REASONING:", ""), "llm_verdict": ("VERDICT:", "UNKNOWN"), "confidence": ("CONFIDENCE:", "LOW"), "correction": ("CORRECTION:", "N/A")}


def entailment_input(parent: Column, claim: Column) -> Column:
    return F.concat(parent, F.lit(" [SEP] "), claim)


def overlap(claim: Column, parent: Column) -> Column:
    """Share of the claim's distinct tokens that the parent has."""
    own = F.array_distinct(T.tokens(claim))
    return F.size(F.array_intersect(own, T.tokens(parent))) / F.greatest(F.size(own), F.lit(1))


def entailment_by_overlap(hits: DataFrame) -> DataFrame:
    """Default entailment provider: adds label and nli_score to hits(claim, parent)."""
    share = F.col("share")
    label = F.when(share >= 0.8, ENTAILMENT).when(share <= 0.2, CONTRADICTION).otherwise(NEUTRAL)
    score = F.when(share >= 0.8, share).when(share <= 0.2, 1 - share).otherwise(1 - F.abs(2 * share - 1))
    return hits.withColumn("share", overlap(F.col("claim"), F.col("parent"))).withColumn("label", label).withColumn("nli_score", F.round(score, 9)).drop("share")


def entailment_by_model(hits: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[tuple[str, float]]]], batch: int = 32, limit: int | None = None, words: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """Entailment by a real model: load() is called once a worker and gives a function of premises and claims.

    Each (parent, claim) is inferred once, however often it was retrieved. Pairs are dealt out and ordered by their number of
    words, so that a batch holds pairs of one length and little of it is padding. With a limit, a pair that has more words
    loses the end of its premise, never of its claim.
    """

    @F.pandas_udf("label string, nli_score double")
    def infer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for parents, claims in batches:
            made = [x for i in range(0, len(parents), batch) for x in model(parents.iloc[i : i + batch].tolist(), claims.iloc[i : i + batch].tolist())]
            yield pd.DataFrame(made, columns=["label", "nli_score"])

    pairs = once(hits.select("parent", "claim").distinct(), ["parent", "claim"], premise=words(F.col("parent")), n_claim=F.size(words(F.col("claim"))))
    premise = F.col("parent")
    if limit is not None:
        room = F.greatest(F.lit(limit) - F.col("n_claim"), F.lit(0))
        premise = F.when(F.size("premise") > room, F.array_join(F.slice("premise", F.lit(1), room), " ")).otherwise(premise)
    sized = pairs.select("parent", "claim", premise.alias("premise"), (F.size("premise") + F.col("n_claim")).alias("size"), F.xxhash64("parent", "claim").alias("tie"))
    dealt = sized.repartitionByRange("size", "tie").sortWithinPartitions("size", "tie")
    inferred = dealt.withColumn("out", infer("premise", "claim")).select("parent", "claim", "out.label", "out.nli_score")
    return hits.join(inferred, ["parent", "claim"])


def best_evidence(scored: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """response_id, doc_id, claim_no, claim, nli_label, nli_score, evidence, is_hallucinated of each claim.

    Among the first hit and all contradictions, the highest score; of equal scores, the first rank. scored has rank,
    parent, label and nli_score.
    """
    label = F.col("label") if case_sensitive else F.upper("label")
    live = scored.where((F.col("rank") == 1) | (label == CONTRADICTION))
    best = F.max_by(F.struct("label", "nli_score", "parent"), F.struct("nli_score", -F.col("rank")))
    rows = live.groupBy(*CLAIM, "claim").agg(best.alias("best"))
    return rows.select(*CLAIM, "claim", F.col("best.label").alias("nli_label"), F.bround("best.nli_score", 3).alias("nli_score"), F.col("best.parent").alias("evidence"), is_hallucinated(F.col("best.label")).alias("is_hallucinated"))


def is_hallucinated(label: Column) -> Column:
    return F.upper(label) == CONTRADICTION


def prompt(parents: Column, claim: Column) -> Column:
    """The judge's prompt: the parents as a list, the claim and the form of the reply."""
    head, rest = PROMPT.split("{source}")
    middle, tail = rest.split("{claim}")
    source = F.array_join(F.transform(parents, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(F.lit(head), source, F.lit(middle), claim, F.lit(tail))


def parsed_reply(raw: Column) -> list[Column]:
    """The four fields of a reply: of the last line with the field's prefix, all prefixes removed; else its default."""
    lines = F.split(T.stripped(raw), "\n")

    def field(prefix: str, default: str, name: str) -> Column:
        last = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), F.lit(-1))
        return F.coalesce(T.stripped(F.replace(last, F.lit(prefix), F.lit(""))), F.lit(default)).alias(name)

    return [field(prefix, default, name) for name, (prefix, default) in REPLY.items()]


def rule_reply() -> Column:
    """A reply in the judge's form, by the label, the score and the fact points of a claim."""
    wrong = (F.upper("nli_label") == CONTRADICTION) | (F.col("points") >= 50)
    return F.concat(
        F.lit("REASONING: The evidence was compared with the claim.\nVERDICT: "),
        F.when(wrong, "HALLUCINATED").otherwise("SUPPORTED"),
        F.lit("\nCONFIDENCE: "),
        F.when(F.col("nli_score") >= 0.9, "HIGH").when(F.col("nli_score") >= 0.5, "MEDIUM").otherwise("LOW"),
        F.lit("\nCORRECTION: "),
        F.when(wrong, F.substring("evidence", 1, 80)).otherwise("N/A"),
    )


def judge_by_rule(gated: DataFrame) -> DataFrame:
    """Default judge: adds raw, the rule's reply."""
    return gated.withColumn("raw", rule_reply())


@dataclass
class Judge:
    """A real judge: call(prompt) gives a reply, with at most `calls` partitions asking at a time, `pause` seconds apart each.

    Equal prompts are asked once. A failed call is tried again up to `tries` times, after `wait` seconds and then twice as long
    each time; after that it is an UNKNOWN verdict whose reasoning names the error, and the claim goes on. Replies are kept by
    prompt in the folder `replies`, which later runs read and add to; errors never are. Without it they are kept for the run.
    """

    call: Callable[[str], str]
    calls: int = 4
    pause: float = 0.0
    replies: str | None = None
    tries: int = 3
    wait: float = 1.0

    def __call__(self, gated: DataFrame) -> DataFrame:
        call, pause, tries, wait = self.call, self.pause, self.tries, self.wait

        def answer(text: str) -> tuple[str, bool]:
            for turn in range(tries):
                try:
                    return call(text), False
                except Exception as e:  # noqa: BLE001  any failure of a remote service
                    error = str(e).replace("\n", " ")
                if turn + 1 < tries:
                    time.sleep(wait * 2**turn)
            return "REASONING: API error: " + error, True

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                replies = []
                for text in batch["text"]:
                    replies.append(answer(text))
                    time.sleep(pause)
                yield pd.DataFrame({"name": batch["name"], "raw": [r for r, _ in replies], "failed": [f for _, f in replies]})

        # the claims with their prompts are made once too: asking and joining must see the same
        asked = stored(gated.select(*CLAIM, prompt(F.col("parents"), F.col("claim")).alias("text")), "prompts")
        spark = gated.sparkSession
        cache = ContentCache(spark, self.replies or scratch(spark, "replies"), "raw string")
        replies = cache.filled(asked, lambda lacking: lacking.repartition(self.calls).mapInPandas(ask, "name string, raw string, failed boolean"))
        return gated.join(asked.join(replies, "text").drop("text"), CLAIM)


def remote_judge(url: str, model: str, key_name: str = "JUDGE_API_KEY", calls: int = 4, seconds: float = 60.0, replies: str | None = None) -> Judge:
    """A judge behind a chat-completions service. Each worker reads the key from its own environment.

    ValueError if the key isn't set where the plan is made; what goes wrong in a call is that claim's UNKNOWN.
    """
    if not os.environ.get(key_name):
        raise ValueError(f"{key_name} isn't set")

    def call(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0.1, "max_tokens": 300}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[key_name]}"}
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return Judge(call, calls, replies=replies)


def judged(gated: DataFrame, judge: Callable[[DataFrame], DataFrame] = judge_by_rule) -> DataFrame:
    """response_id, doc_id, claim_no and the judge's parsed reply for each gated claim."""
    return judge(gated).select(*CLAIM, *parsed_reply(F.col("raw")), F.col("raw").alias("llm_raw"))


def first_rank(hits: DataFrame) -> DataFrame:
    """hits with each (claim, parent) once, at its best rank."""
    order = Window.partitionBy(*CLAIM, "parent").orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
