"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from regular expressions: the four fixed formats, and seven looser forms, which also find what a
greedy match of a fixed format has swallowed. Four labelers vote on each: a shape check, a gazetteer, the context words before it, and the
characters at its edges. Votes are counted by pattern, of which there are only so many;
expectation-maximisation over these counts estimates how reliable each labeler is, and its posteriors train a
logistic span classifier. Spans of the fixed formats always stay; the classifier adds others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import table, written

#: The kinds of the fixed formats, and the looser forms, whose spans are shown as "other".
FIXED = ("email", "ip", "card", "phone")
KINDS = (*FIXED, "national", "abroad", "account", "mailed", "iban", "host", "social")
LABELERS = ("shape", "gazetteer", "context", "edges")
#: Probability from which the classifier adds a candidate.
ACCEPT = 0.75
EM_ROUNDS, FIT_ROUNDS, FIT_RATE = 60, 300, 0.5
#: Belief in a candidate of a fixed format.
SURE = 0.99
#: What share of its votes a labeler is taken to cast against, not at all and for, on false candidates and on true ones:
#: one that says both, one that checks digits, one that only speaks against and one that only speaks for.
BOTH, DIGITS = ((0.6, 0.35, 0.05), (0.02, 0.38, 0.6)), ((0.8, 0.1, 0.1), (0.1, 0.1, 0.8))
AGAINST_ONLY, FOR_ONLY = ((0.3, 0.7, 0.0), (0.1, 0.9, 0.0)), ((0.0, 0.9, 0.1), (0.0, 0.5, 0.5))
#: Weight of this beside the candidates.
TRUST = 4
#: Looser forms whose shape is checked by digits or leaves little doubt.
CHECKED = ("account", "iban", "host")
CONTEXT_CHARS = 48

#: The formats, with possessive loops and anchored starts, so that matching takes linear time and no deep stack. An
#: anchored start loses nothing: a run that fails from its first character, or from the end of the match before, fails
#: from any later one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9A-Za-z+./-])(?<![0-9]\x20)(?:\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,5}|0[0-9](?:[\x20.-][0-9]{2}){4})(?![0-9A-Za-z/-])(?![\x20.][0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z-])",
    "mailed": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "host": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "social": r"(?<![0-9A-Za-z+./-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z/-])(?!\.[0-9])",
}
#: What a text must hold for a pattern to be tried; all but those of mail need a digit.
HINTS = {"email": "@", "phone": "+", "abroad": "+", "mailed": "dot", "host": ":", "social": "-"}

# Cue words before personal data in four languages, words that speak against it, known top-level domains.
CUES = "ssn social security bic ipv6 reach dial phone tel telephone call fax mobile cell mail email e-mail contact write card visa mastercard account iban ip address host server telefon handy anruf anrufen kontakt karte konto adresse téléphone appel appelez courriel carte compte adresse teléfono llame llamar correo tarjeta cuenta dirección"
AGAINST = "build release revision serial order invoice part item lot line version page chapter section figure table isbn seite kapitel abschnitt tabelle chapitre tableau página capítulo sección tabla"
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE"
DOMAINS = "com org net edu gov mil int info biz io dev de fr es uk eu us ca at ch it nl be pt mx ar cl"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points) and value of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(done["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    return F.aggregate(pairs, empty, step, lambda done: done["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the check sum."""
    turned = F.split(F.reverse(digits(value)), "")

    def weigh(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(turned, weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def iban(bare: Column) -> Column:
    """Whether the check digits of an account number without blanks are right: its turned number is 1 modulo 97."""
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    number = lambda c: F.when(c.rlike("[0-9]"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + number(c)) % 97) == 1


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the fixed format."""
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(F.regexp_replace(part, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _words(listed: str) -> str:
    return "|".join(sorted({w.replace("-", "\\-") for w in listed.split()}))


def _votes(kind: str, text: Column, x: Column) -> list[Column]:
    """The labelers' votes on a span as 0 (against), 1 (none) or 2 (for), in the order of LABELERS."""
    value = x["value"]
    n = F.length(digits(value))
    before = F.lower(text.substr(F.greatest(x["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT_CHARS))))
    left = F.when(x["start"] > 0, text.substr(x["start"], F.lit(1))).otherwise(F.lit(" "))
    right = F.coalesce(text.substr(x["end"] + 1, F.lit(1)), F.lit(""))
    if kind == "email":
        shape = value.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@.*\.[A-Za-z]{2,}$")
        known = F.lower(value).rlike(rf"\.(?:{_words(DOMAINS)})$")
    elif kind == "ip":
        shape, known = valid("ip", value), value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    elif kind in ("card", "account"):
        shape, known = valid("card", value), n.between(13, 19) & value.rlike("^[3-6]")
    elif kind in ("phone", "abroad"):
        shape, known = n.between(8, 15), value.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
    elif kind == "national":
        shape, known = n.between(9, 12), value.rlike(r"^\(?(?:0[1-9]|[2-9][0-9]{2}\)?[\x20.-][2-9])")
    elif kind == "mailed":
        shape, known = value.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2,}$"), F.lower(value).rlike(rf"(?:{_words(DOMAINS)})$")
    elif kind == "iban":
        bare = F.replace(value, F.lit(" "), F.lit(""))
        shape, known = iban(bare), bare.rlike(rf"^(?:{COUNTRIES.replace(' ', '|')})")
    elif kind == "host":
        shape, known = value.rlike("[0-9]"), value.rlike("^(?:2[0-9a-fA-F]{3}|[fF][cdCDeE])")
    else:
        shape, known = ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit(False)
    three = lambda yes, no: F.when(yes, 2).when(no, 0).otherwise(1)
    # A looser form says little by itself: its shape speaks for it only by check digits, its edges only against it.
    sure = F.lit(kind in (*FIXED, *CHECKED))
    return [
        three(shape & sure, ~shape),
        three(known, F.lit(False)),
        three(before.rlike(rf"(?<![\p{{L}}])(?:{_words(CUES)})[^\p{{L}}]*$"), before.rlike(rf"(?<![\p{{L}}])(?:{_words(AGAINST)})[^\p{{L}}]*$")),
        three(left.rlike(r"^[\s(\"':;,]$") & right.rlike(r"^(?:[\s)\"':;,.!?])?$") & F.lit(kind in FIXED), left.rlike(r"^[\p{L}0-9$€£#=_/]$") | right.rlike(r"^[\p{L}0-9%€_/]$")),
    ]


def _sizes(value: Column) -> list[Column]:
    """Buckets of the number of digits and of separators."""
    n = F.length(digits(value))
    m = F.length(F.regexp_replace(value, r"[^\x20().-]", ""))
    return [F.when(n < 8, 0).when(n < 13, 1).when(n < 16, 2).otherwise(3), F.when(m == 0, 0).when(m < 3, 1).otherwise(2)]


FEATURES = (("kind", len(KINDS)), *((name, 3) for name in LABELERS), ("n_digits", 4), ("n_signs", 3))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, for each row of docs(doc_id, text), all candidates: kind, start, end, base, votes and size buckets.

    base marks the fixed formats; their matches that fail the format's check are none. Null and empty texts have no candidates; repeated rows repeat.
    """
    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("digital", F.col("text").rlike("[0-9]"))  # not once for each pattern
    text, none = F.col("text"), F.array().cast(_SPAN)
    for kind, pattern in PATTERNS.items():
        hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        out = out.withColumn(f"m_{kind}", F.when(hint & (F.col("digital") if kind not in ("email", "mailed") else F.lit(True)), matches(text, pattern)).otherwise(none))
    parts = []
    for k, kind in enumerate(KINDS):

        def judged(x: Column, k=k, kind=kind) -> Column:
            votes = [v.cast("int").alias(name) for name, v in zip(LABELERS, _votes(kind, text, x), strict=True)]
            sizes = [s.cast("int").alias(name) for name, s in zip(("n_digits", "n_signs"), _sizes(x["value"]), strict=True)]
            base = F.lit(kind in FIXED)
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), *votes, *sizes)

        kept = F.filter(f"m_{kind}", _unary(lambda x, kind=kind: valid(kind, x["value"]))) if kind in FIXED else F.col(f"m_{kind}")
        out = out.withColumn(f"c_{kind}", F.transform(kept, _unary(judged)))
        parts.append(f"c_{kind}")
    return out.select("doc_id", F.concat(*parts).alias("found"))


def _unary(f):
    return lambda x: f(x)


def patterns(found: DataFrame) -> dict[tuple[int, ...], int]:
    """Counts of the candidates' feature patterns: at most the product of the features' sizes, 10,692 rows."""
    names = [name for name, _ in FEATURES]
    rows = found.select(F.explode("found").alias("x")).groupBy(*[F.col(f"x.{name}").alias(name) for name in names]).agg(F.count("*").alias("n"))
    return {tuple(r[name] for name in names): r["n"] for r in rows.collect()}


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[list[float], list[list[list[list[float]]]], dict[tuple[int, ...], float]]:
    """(prior by kind, P(vote | class) by kind, labeler and class, posterior by pattern) by expectation-maximisation.

    Each kind has reliabilities of its own, as the labelers ask different things of it. It starts from what a labeler of its
    sort is taken to be like; that goes on to count TRUST times as much as the kind's candidates,
    so that a kind of one class alone isn't split, nor two classes made one, by a single labeler. Votes are taken as
    independent given the class. Candidates of the fixed formats are known to be true.
    """
    belief: dict[tuple[int, ...], float] = {}
    priors, tables = [0.5] * len(KINDS), [[[[1 / 3] * 3] * 2 for _ in LABELERS] for _ in KINDS]
    for kind in sorted({p[0] for p in counts}):
        own = {p: n for p, n in counts.items() if p[0] == kind}
        total = sum(own.values())
        before = (DIGITS if KINDS[kind] in CHECKED else AGAINST_ONLY, FOR_ONLY, BOTH, AGAINST_ONLY)
        if kind < len(FIXED):
            before = (BOTH,) * len(LABELERS)
        tables[kind] = [list(map(list, both)) for both in before]
        for _ in range(EM_ROUNDS):
            for p in own:
                logit = math.log(priors[kind] / (1 - priors[kind])) + sum(math.log(tables[kind][k][1][p[1 + k]] / tables[kind][k][0][p[1 + k]]) for k in range(len(LABELERS)))
                belief[p] = SURE if kind < len(FIXED) else 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
            priors[kind] = (sum(n * belief[p] for p, n in own.items()) + total / 2) / (2 * total)
            sums = [[[x * total * TRUST for x in side] for side in both] for both in before]
            for p, n in own.items():
                for k in range(len(LABELERS)):
                    sums[k][1][p[1 + k]] += n * belief[p]
                    sums[k][0][p[1 + k]] += n * (1 - belief[p])
            tables[kind] = [[[x / sum(side) for x in side] for side in both] for both in sums]
    return priors, tables, belief


def classifier(counts: dict[tuple[int, ...], int], belief: dict[tuple[int, ...], float]) -> tuple[float, list[list[float]]]:
    """(bias, weights by feature and value) of a logistic model of the posteriors, by gradient steps over the patterns."""
    bias, weights = 0.0, [[0.0] * size for _, size in FEATURES]
    total = sum(counts.values()) or 1
    for _ in range(FIT_ROUNDS):
        slope, slopes = 0.0, [[0.001 * w for w in row] for row in weights]
        for p, n in counts.items():
            logit = bias + sum(weights[i][v] for i, v in enumerate(p))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))) - belief[p]) * n / total
            slope += error
            for i, v in enumerate(p):
                slopes[i][v] += error
        bias -= FIT_RATE * slope
        for row, change in zip(weights, slopes, strict=True):
            for v, s in enumerate(change):
                row[v] -= FIT_RATE * s
    return bias, weights


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end), base ones and those that the classifier adds, of each row of docs(doc_id, text).

    An added span overlaps no other: of those that do, the first stays, of those with one start the longest. Null and empty
    texts have none; repeated rows repeat.
    """
    found = written(candidates(docs), "candidates")
    counts = patterns(found)
    _, _, belief = reliabilities(counts)
    bias, weights = classifier(counts, belief)
    cut = math.log(ACCEPT / (1 - ACCEPT))

    def wanted(x: Column) -> Column:
        logit = sum((F.element_at(F.array(*map(F.lit, row)), x[name] + 1) for (name, _), row in zip(FEATURES, weights, strict=True)), F.lit(bias))
        return logit >= cut

    out = found.withColumn("fixed", F.filter("found", lambda x: x["base"]))
    added = F.filter("found", lambda x: ~x["base"] & wanted(x) & ~F.exists("fixed", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    ordered = F.array_sort(F.transform(added, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("until"))))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def sweep(done: Column, x: Column) -> Column:
        """Takes a span that starts where the one before has ended."""
        one = F.struct(F.lit("other").alias("kind"), x["start"].alias("start"), (-x["until"]).alias("end"))
        free = x["start"] >= done["at"]
        return F.struct(F.when(free, -x["until"]).otherwise(done["at"]).alias("at"), F.when(free, F.array_append(done["out"], one)).otherwise(done["out"]).alias("out"))

    more = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), none.alias("out")), sweep, lambda done: done["out"])
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    shown = F.transform(F.col("fixed"), lambda x: F.struct(name(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", F.concat(shown, more).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and spans of every row of documents; null and empty texts have none, repeated rows repeat.

    A null doc_id is one like any other; other columns are not read; without rows there is nothing.
    """
    rows = spans(table(spark, sf_dir, "documents"))
    listed = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "other")
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in (*FIXED, "other")]
    return rows.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(F.array_join(F.transform(base, listed), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", listed), ",").alias("spans"))


def _of(kind: str):
    return lambda x: x["kind"] == kind
