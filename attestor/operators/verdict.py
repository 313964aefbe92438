"""The gate before the judge, and the fusion of entailment, judge and facts into a verdict."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.operators.models import CONTRADICTION, ENTAILMENT

SURE_ENTAILMENT, SURE_CONTRADICTION, GATE_CONTRADICTION = 0.85, 0.85, 0.92
CLEAN, FACTS_ASK, FACTS_STRONG = 20, 40, 50


def needs_judge(label: Column, score: Column, points: Column) -> Column:
    """Whether a claim goes to the judge: facts disagree, or the entailment model isn't sure."""
    up = F.upper(label)
    return F.when(points >= FACTS_ASK, True).when((up == ENTAILMENT) & (score >= SURE_ENTAILMENT) & (points < CLEAN), False).when((up == CONTRADICTION) & (score >= GATE_CONTRADICTION), False).otherwise(True)


def _exact_scores() -> dict[tuple[int, int, int, int], float]:
    """Scores by (case, points, contradicts, judged wrong), rounded to hundredths as doubles are: half to even on the exact value."""
    out = {}
    for five, c, h in product(range(21), (0, 1), (0, 1)):
        f = five * 5 / 100
        out[1, five, c, h] = round(min(0.5 * f + 0.3 * float(c) + 0.2 * float(h), 1.0), 2)
        out[3, five, c, h] = round(min(0.6 + (0.2 * f) + (0.2 if h else 0.0), 1.0), 2)
        out[4, five, c, h] = round(0.4 * float(c) + 0.35 * float(h) + 0.25 * f, 2)
        out[5, five, c, h] = round(0.3 + (0.2 * f), 2)
    return out


_SCORES = _exact_scores()


def _score(case: int, points: Column, c: Column, h: Column) -> Column:
    """The case's score: points are multiples of 5, so all scores are a table of 84."""
    values = [_SCORES[case, five, x, y] for five, x, y in product(range(21), (0, 1), (0, 1))]
    at = (F.floor(points / 5) * 4 + c.cast("int") * 2 + h.cast("int")).cast("int")
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def verdict(label: Column, nli_score: Column, evidence: Column, points: Column, signals: Column, judged: Column, llm_verdict: Column, reasoning: Column, confidence: Column, correction: Column) -> Column:
    """The verdict of a claim as a struct. judged: whether there is a judge's result; its fields may be null otherwise.

    The explanations' texts are fixed values.
    """
    up = F.upper(label)
    c = F.coalesce(up == CONTRADICTION, F.lit(False))
    h = judged & F.coalesce(llm_verdict == "HALLUCINATED", F.lit(False))
    reason = F.when(judged, F.coalesce(reasoning, F.lit(""))).otherwise("")
    fixed = F.when(judged, F.coalesce(correction, F.lit("N/A"))).otherwise("N/A")
    two = F.array_join(F.slice(signals, 1, 2), "; ")
    more = F.when(reason != "", F.concat(F.lit(" | "), reason)).otherwise("")
    has = F.size(signals) > 0
    none = F.array().cast("array<string>")

    # Case 1 holds from a score of .4 on; with points in hundredths that is 50 p + 3000 c + 2000 h >= 4000.
    strong = (points >= FACTS_STRONG) & (points * 50 + c.cast("int") * 3000 + h.cast("int") * 2000 >= 4000)
    very = points * 50 + c.cast("int") * 3000 + h.cast("int") * 2000 >= 6000
    entailed = (up == ENTAILMENT) & (nli_score >= SURE_ENTAILMENT) & (points < CLEAN)
    contradicted = c & (nli_score >= SURE_CONTRADICTION)

    def case(number: int, name: Column | str, score: Column, sure: Column | str, explanation: Column, fix: Column, why: Column, shown: Column, used: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(number).alias("case"), lit(name).alias("verdict"), score.alias("hallucination_score"), lit(sure).alias("confidence"), explanation.alias("explanation"), fix.alias("correction"), why.alias("reasoning"), evidence.alias("evidence"), shown.alias("fact_signals"), used.alias("llm_used"))

    na, empty, no, yes = F.lit("N/A"), F.lit(""), F.lit(False), F.lit(True)
    fused = _score(4, points, c, h)
    first = case(1, "Hallucinated", _score(1, points, c, h), F.when(very, "HIGH").otherwise("MEDIUM"), F.concat(F.lit("Fact check failed: "), two, more), fixed, reason, signals, judged)
    second = case(2, "Supported", F.lit(0.0), "HIGH", F.lit("Source directly supports this claim."), na, empty, none, no)
    third = case(3, "Hallucinated", _score(3, points, c, h), "HIGH", F.concat(F.lit("Source contradicts this claim."), F.when(has, F.concat(F.lit(" | "), two)).otherwise(""), more), fixed, reason, signals, judged)
    apart = F.when(c != h, F.concat(F.lit("[Models disagree] "), reason)).otherwise(reason)
    fourth = case(4, F.when(fused >= 0.6, "Hallucinated").when(fused >= 0.3, "Uncertain").otherwise("Supported"), fused, F.coalesce(confidence, F.lit("MEDIUM")), F.concat(apart, F.when(has, F.concat(F.lit(" | Fact issues: "), two)).otherwise("")), fixed, reason, signals, yes)
    fifth = case(5, "Uncertain", _score(5, points, c, h), "LOW", F.concat(F.lit("Insufficient evidence. "), F.when(has, two).otherwise("")), na, empty, signals, no)
    return F.when(strong, first).when(entailed, second).when(contradicted, third).when(judged, fourth).otherwise(fifth)
