"""Secret scans: fixed formats, and random-looking strings by a ratio of character Markov models.

Two first-order Markov chains over characters are trained from labelled strings: values of the fixed formats
and seeded random draws on one side, words and identifiers of the corpus and compounds of them on the other. A string
is reported if its log-likelihood ratio outweighs how rare secrets are, so a short one must look more random a character.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import chunked, table

KINDS = ("assign", "access", "hex", "random")
#: The models are fitted on at most so many rows, the first by a hash of doc_id, whole texts of any length.
FIT_ROWS = 2000
#: Seeded draws that stand beside the corpus's own secrets.
DRAWS = 4000
#: Candidates are runs of so many token characters or more with a letter, where fixed formats leave them over.
LEAST_LENGTH = 16
#: Log-likelihood ratio from which a candidate is reported (the log of how much rarer secrets are), and its least mean.
EVIDENCE, LEAST_MEAN = 18.0, 0.8
#: Weight, in characters, of the characters' own frequencies in each row of transitions.
BACK_OFF = 20.0

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{2,}(?![A-Za-z0-9+/_=-])")
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, len(_ALPHABET), dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i
_IN_TOKEN = np.zeros(256, dtype=bool)
_IN_TOKEN[[ord(c) for c in _ALPHABET]] = True

Span = tuple[int, int, int]


def base_spans(text: str, runs: Iterable[tuple[int, int]] | None = None) -> list[Span]:
    """(start, index in KINDS, end) of the fixed formats. runs: where hexadecimal runs can be, if known."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for a, b in [(0, len(text))] if runs is None else runs:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return sorted(found)


@dataclass
class Ratio:
    """Log-likelihood ratios of first characters and of transitions."""

    first: np.ndarray
    step: np.ndarray

    @staticmethod
    def fit(random_strings: Iterable[str], ordinary: Iterable[str]) -> Ratio:
        return Ratio.of(counted(random_strings), counted(ordinary))

    @staticmethod
    def of(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> Ratio:
        """From the counts of either side; rare contexts fall back on the characters' own frequencies."""
        n = len(_ALPHABET) + 1
        sides = []
        for counts in (random_counts, ordinary_counts):
            first, step = counts[0] + 0.5, counts[1:].astype(np.float64)
            single = (step.sum(axis=0) + 0.5) / (step.sum() + 0.5 * n)
            step = (step + BACK_OFF * single) / (step.sum(axis=1, keepdims=True) + BACK_OFF)
            sides.append((np.log(first / first.sum()), np.log(step)))
        (fa, sa), (fb, sb) = sides
        return Ratio(fa - fb, sa - sb)

    def score(self, s: str) -> float:
        """The log-likelihood ratio of the whole string."""
        c = _CODE[np.frombuffer(s.encode(), dtype=np.uint8)]
        return float(self.first[c[0]] + self.step[c[:-1], c[1:]].sum())

    def random(self, s: str) -> bool:
        """Whether the string is reported."""
        score = self.score(s)
        return score >= EVIDENCE and score >= LEAST_MEAN * len(s)


def counted(strings: Iterable[str]) -> np.ndarray:
    """Counts of first characters (row 0) and of transitions (a row for each character)."""
    n = len(_ALPHABET) + 1
    raw = np.frombuffer("\n".join(["", *strings]).encode(), dtype=np.uint8)
    code, border = _CODE[raw] + 1, raw == 10
    code[border] = 0
    pairs = (code[:-1] * n + code[1:] - 1)[~border[1:]]
    return np.bincount(pairs, minlength=(n + 1) * n).reshape(n + 1, n)


def draws(n: int, seed: int = 5) -> list[str]:
    """Seeded random strings over the alphabets that keys are written in."""
    rng = random.Random(seed)
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    sets = (string.digits + "abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", upper + string.digits, lower + string.digits, string.ascii_letters, lower)
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 64))) for i in range(n)]


def compounds(words: list[str]) -> list[str]:
    """Identifiers, paths and numbered names of neighbouring words, in turn."""
    out = []
    for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
        n = zlib.crc32(a.encode()) % 10_000
        forms = (f"{a}_{b}", f"{a}-{b}", a + b.capitalize(), f"{a}/{b}", f"{a}_{b}_{n % 100}", f"{a}{n % 10}", f"{a}-{2000 + n % 30}-{1 + n % 12:02}-{1 + n % 28:02}", f"{a.upper()}_{b.upper()}", f"{a}/{b}/{n}", a + b)
        out.append(forms[i % len(forms)])
    return out


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Random strings and ordinary ones of a text: values inside fixed formats; words outside of them, and their compounds.

    A word of LEAST_LENGTH characters or more is what is to be judged, so it has no label.
    """
    spans = base_spans(text)
    secret = [m for a, _, e in spans for m in _TOKEN.findall(text[a:e]) if len(m) >= LEAST_LENGTH]
    words, at = [], 0
    for a, e in [*((a, e) for a, _, e in spans), (len(text), 0)]:
        words += [w for w in _WORD.findall(text, at, a) if len(w) < LEAST_LENGTH] if a > at else []
        at = max(at, e)
    return secret, words + compounds(words)


def fitted(docs: DataFrame, rows: int = FIT_ROWS) -> Ratio:
    """The ratio fitted on at most `rows` rows of docs(doc_id, text). Executors count; the driver gets a count a transition."""
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("mark", F.xxhash64("text"))
    ids = sample.select("doc_id", "mark").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(rows)
    ids = ids.select(F.col("doc_id").alias("k_doc_id"), F.col("mark").alias("k_mark"))
    texts = sample.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("mark") == F.col("k_mark"))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, len(_ALPHABET) + 2, len(_ALPHABET) + 1), dtype=np.int64)
            for text in batch.column(0).to_pylist():
                for side, strings in enumerate(labelled(text)):
                    sums[side] += counted(strings)
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums.ravel()[full])], names=["place", "n"])

    sums = np.zeros((2, len(_ALPHABET) + 2, len(_ALPHABET) + 1), dtype=np.int64)
    for r in texts.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums.ravel()[r.place] = r.n
    if not sums[1].any():
        sums[1] = counted(["identifier"])
    return Ratio.of(sums[0] + counted(draws(DRAWS)), sums[1])


def _runs(text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(row, byte spans of token runs of LEAST_LENGTH or more) for rows that have any."""
    for lo, hi, buf, offs in chunked(text):
        n = len(buf)
        gaps = np.concatenate([[-1], np.flatnonzero(~_IN_TOKEN[buf]), [n]])
        gaps = np.unique(np.concatenate([gaps, offs[1:-1] - 0.5]))  # borders of texts end runs too
        starts, ends = np.floor(gaps[:-1] + 1).astype(np.int64), np.ceil(gaps[1:]).astype(np.int64)
        long = np.flatnonzero(ends - starts >= LEAST_LENGTH)
        at = np.searchsorted(starts[long], offs, side="left")
        for row in np.flatnonzero(np.diff(at)).tolist():
            own = long[at[row] : at[row + 1]]
            yield lo + row, list(zip((starts[own] - offs[row]).tolist(), (ends[own] - offs[row]).tolist(), strict=True))


def _points(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as code-point spans."""
    if text.isascii():
        return runs
    raw = text.encode()
    out, at, point = [], 0, 0
    for a, b in runs:
        point += len(raw[at:a].decode())
        out.append((point, point + b - a))
        at, point = b, point + b - a
    return out


def _left_over(a: int, b: int, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Parts of LEAST_LENGTH or more of a run that spans, sorted by start, leave over."""
    for x, _, e in taken:
        if e > a and x < b:
            if x - a >= LEAST_LENGTH:
                yield a, x
            a = e
    if b - a >= LEAST_LENGTH:
        yield a, b


def spans_of(text: pa.Array, ratio: Ratio) -> list[list[Span]]:
    """The spans of each text, those of random strings too, by start and then kind."""
    values = text.to_pylist()
    runs = dict(_runs(text))
    out: list[list[Span]] = []
    for row, value in enumerate(values):
        value = value or ""
        at = _points(value, runs[row]) if row in runs else []
        found, first, added = base_spans(value, at), 0, []
        for a, b in at:
            while first < len(found) and found[first][2] <= a:
                first += 1
            for x, y in _left_over(a, b, found[first : bisect_left(found, (b, 0, 0))]):
                if any(map(str.isalpha, value[x:y])) and ratio.random(value[x:y]):
                    added.append((x, 3, y))
        out.append(sorted(found + added))
    return out


def scanned(docs: DataFrame, ratio: Ratio | None = None) -> DataFrame:
    """doc_id and spans of each row of docs(doc_id, text); null and empty texts have none, repeated rows repeat."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio or fitted(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column(1), shared.value)
            kinds = pa.array([[KINDS[k] for _, k, _ in x] for x in found], type=pa.list_(pa.string()))
            starts, ends = (pa.array([[s[i] for s in x] for x in found], type=pa.list_(pa.int64())) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds, starts, ends], names=["doc_id", "kinds", "starts", "ends"])

    return docs.mapInArrow(scan, "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>").select("doc_id", F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask, and n_chars, where present, brought up to date.

    All rows and columns, of any names, stay, repeated rows and those without doc_id too; a null text stays null.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row, spans in enumerate(spans_of(batch.column(at), shared.value)):
                if spans:
                    text, parts, done = texts[row], [], 0
                    for a, _, e in spans:
                        if e > done:
                            parts += [text[done:a], mask] if a >= done else []
                            done = e
                    texts[row] = "".join([*parts, text[done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    out = docs.mapInArrow(redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and spans of every row of documents; null and empty texts have none, repeated rows repeat.

    A null doc_id is one like any other; other columns are not read; without rows there is nothing.
    """
    spans = F.col("spans")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(spans, lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, text), ",").alias("spans"),
    )
