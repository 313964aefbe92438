"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood under character trigram models; the declared markup language and the address suffix
give likelihoods by confusion tables; the host gives a prior, smoothed from host to domain to all. Tables and priors
are sums of the text's posteriors over all documents, made by grouped aggregation; a document's own share is taken
out of its host's prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import chunked, met, table, written
from attestor.llm.toxicity import lowered_safely

#: Each trigram model is fitted on at most so many of the rows that declare its language, drawn by a hash of doc_id and text.
FIT_ROWS = 1000
#: A language is modelled if so many of all rows declare it, and it is among the most frequent ones: a model takes 1 MiB of
#: the driver while it is fitted and 256 KiB of each worker.
LEAST_ROWS, MOST_LANGUAGES = 5, 256
GRAMS = 1 << 16
#: Log-probability of a trigram if all are alike, and how far a text's mean may fall from what its language's own texts
#: reach (held out) towards that, before no language is the better explanation.
EVEN, UNEXPLAINED = -float(np.log(GRAMS)), 2 / 3
#: Neighbouring trigrams overlap, so their log-likelihood counts by this part.
TEMPER = 1 / 3
#: Weight, in documents, of the level above in a prior, and of the uniform in a confusion table.
SMOOTH = 5.0
#: A language is accepted from this posterior on.
LEAST_POSTERIOR = 0.5
#: Parts that the rows of a key are dealt over.
SALTS = 32
#: So many ids at most (8 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[0x80:] = True


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased letters, with blanks for all else, and where each text's begin."""
    low = lowered_safely(buf)
    low = np.where(_LETTERS[low], low, np.uint8(32)).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offs), dtype=np.int64)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    ok = ((low[:-2] != 32).astype(np.uint8) + (low[1:-1] != 32) + (low[2:] != 32)) >= 2
    starts = np.zeros(len(low) + 1, dtype=bool)
    starts[offs] = True
    ok &= ~(starts[1 : len(low) - 1] | starts[2 : len(low)])
    at = np.flatnonzero(ok)
    return ((code[at] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, offs, side="left")


@dataclass
class TextModel:
    """Log-probabilities of trigrams, a column for each language, and the mean below which a language explains no text."""

    languages: list[str]
    table: np.ndarray
    floors: np.ndarray

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> TextModel:
        """Of trigram counts by language, a row for each half of its texts. Each half is scored by a model of the other."""
        langs = sorted(counts)
        table, floors = np.zeros((GRAMS, max(1, len(langs))), dtype=np.float32), np.full(max(1, len(langs)), EVEN)
        for i, lang in enumerate(langs):
            held = counts[lang]
            table[:, i] = _logs(held.sum(axis=0))
            own = (held[0] @ _logs(held[1]) + held[1] @ _logs(held[0])) / held.sum() if held.any() else EVEN
            floors[i] = own - UNEXPLAINED * max(0.0, own - EVEN)
        return TextModel(langs, table, floors)

    def likelihoods(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, log-likelihoods) of each text; a last column is that of no language modelled."""
        g, at = grams(buf, offs)
        out = np.zeros((len(offs) - 1, len(self.languages) + 1))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[full, :-1] = np.add.reduceat(self.table[g], at[full], axis=0, dtype=np.float64)
            out[full, -1] = np.diff(at)[full] * self.floors[out[full, :-1].argmax(axis=1)]
        return np.diff(at), out


def _logs(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.05
    return np.log(smooth / smooth.sum())


def fitted(docs: DataFrame, rows: int = FIT_ROWS, languages: int = MOST_LANGUAGES) -> TextModel:
    """The trigram models of docs(doc_id, text, declared), on at most `rows` rows of each language, drawn by a hash.

    Whole texts of any length count. A language needs LEAST_ROWS rows among all; where none has them, those of the first
    `rows` rows are modelled. Of more than `languages` declared strings the most frequent are modelled: what else is declared
    remains evidence like any other. Executors count the trigrams, so the driver gets GRAMS counts for each half of a language
    at most.
    """
    sample = docs.where("declared is not null and text is not null").withColumn("draw", F.xxhash64("doc_id", "text"))
    # Twice as many rows as wanted are drawn by hash, so that no task ranks all rows of a frequent language.
    share = sample.groupBy("declared").agg(F.count("*").alias("n")).select(F.col("declared").alias("k_declared"), "n", F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("n")).alias("share"))
    # no more than `languages` rows are left to be broadcast
    share = F.broadcast(written(share.orderBy(F.desc(F.col("n") >= LEAST_ROWS), F.desc("n"), "k_declared").limit(languages), "declared"))
    chance = F.pmod(F.xxhash64("draw"), F.lit(1 << 30)) / float(1 << 30)
    some = sample.select("declared", "draw").join(share, F.col("declared") == F.col("k_declared")).where(chance < F.col("share"))
    one = Window.partitionBy("declared").orderBy("draw")
    ids = written(some.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= rows).select("declared", "draw", "rank", "n"), "drawn")
    drawn = ids.where(F.col("n") >= LEAST_ROWS)
    if drawn.isEmpty():
        drawn = ids.orderBy("draw", "declared").limit(rows)
    # repeated rows count in the same half
    drawn = drawn.groupBy("draw", "declared").agg((F.min("rank") % 2).cast("int").alias("half"))
    # languages * rows keys at most, of some 20 bytes
    texts = sample.join(F.broadcast(drawn), ["draw", "declared"]).select("declared", "half", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sums: dict[tuple[str, int], np.ndarray] = {}
            for lo, hi, buf, offs in chunked(batch.column(2)):
                g, at = grams(buf, offs)
                for i in range(lo, hi):
                    sums.setdefault(keys[i], np.zeros(GRAMS, dtype=np.int64))[:] += np.bincount(g[at[i - lo] : at[i - lo + 1]], minlength=GRAMS)
            for (lang, half), n in sums.items():
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), type=pa.string()), pa.array(np.full(len(full), half, dtype=np.int32)), pa.array(full.astype(np.int32)), pa.array(n[full])], names=["declared", "half", "gram", "n"])

    def pack(key, rows):
        import pandas as pd

        n = np.zeros(GRAMS, dtype="<i8")
        n[rows["gram"]] = rows["n"]
        return pd.DataFrame({"declared": [key[0]], "half": [key[1]], "counts": [n.tobytes()]})

    summed = texts.mapInArrow(count, "declared string, half int, gram int, n bigint").groupBy("declared", "half", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in summed.groupBy("declared", "half").applyInPandas(pack, "declared string, half int, counts binary").collect():
        counts.setdefault(r.declared, np.zeros((2, GRAMS), dtype=np.int64))[r.half] = np.frombuffer(r.counts, dtype="<i8")
    return TextModel.of(counts)


def evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """doc_id, declared, suffix, host, n_grams and posterior, the text's alone under a uniform prior (as log, unscaled)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunked(batch.column(1)):
                n, like = shared.value.likelihoods(buf, offs)
                width = like.shape[1]
                column = pa.ListArray.from_arrays(pa.array((np.arange(hi - lo + 1) * width).astype(np.int32)), pa.array(like.ravel() * TEMPER))
                kept = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64)), column], names=["doc_id", "declared", "suffix", "host", "n_grams", "likely"])

    return docs.select("doc_id", "text", "declared", "suffix", "host").mapInArrow(weigh, "doc_id bigint, declared string, suffix string, host string, n_grams bigint, likely array<double>")


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def _normal(logs: Column) -> Column:
    """Probabilities from logs."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], of: str, width: int, *more: Column) -> DataFrame:
    """Summed arrays of the rows of each key, as one array `sums`, and more aggregates."""
    parts = [F.sum(F.col(of)[i]).alias(f"s{i}") for i in range(width)]
    rows = rows.groupBy(*keys).agg(*parts, *more)
    return rows.withColumn("sums", F.array(*[f"s{i}" for i in range(width)])).drop(*[f"s{i}" for i in range(width)])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _smoothed(counts: str, above: Column) -> Column:
    """The shares of counts, with the level above as SMOOTH documents more."""
    return F.zip_with(counts, above, lambda n, p: (n + SMOOTH * p) / (_total(F.col(counts)) + SMOOTH))


def _shares(counts: str, common: Column, base: list[float], total: float) -> Column:
    """Logs of the key's share among each language's documents, smoothed by its share of all documents."""
    return F.zip_with(counts, F.array(*[F.lit(b * total) for b in base]), lambda n, m: F.log((n + SMOOTH * common) / (m + SMOOTH)))


def identified(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """doc_id, language, posterior, text_language and accepted of each row of docs(doc_id, text, declared, suffix, host).

    A text without letters has no language and is rejected, as is a best posterior below LEAST_POSTERIOR. So is a text that
    no model explains: no language modelled is a class of its own, with null as language. Evidence that is null counts nothing. Repeated rows are judged alike. With no declared language at all every row is rejected.
    """
    kinds = {"doc_id": "long", "text": "string", "declared": "string", "suffix": "string", "host": "string"}
    docs = docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    model = model or fitted(docs)
    if not model.languages:
        none = F.lit(None).cast("string")
        return docs.select("doc_id", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(False).alias("accepted"))
    width = len(model.languages) + 1
    names = F.array(*map(F.lit, model.languages), F.lit(None).cast("string"))
    zeros = F.array(*[F.lit(0.0)] * width)
    rows = written(evidence(docs, model), "evidence")
    rows = rows.withColumn("own", F.when(F.col("n_grams") > 0, _normal(F.col("likely"))).otherwise(zeros))

    # one row: what share of all documents has each language
    every = rows.agg(*[F.sum(F.col("own")[i]) for i in range(width)]).first()
    total = sum(x or 0.0 for x in every)
    base = [((x or 0.0) + 1.0) / (total + width) for x in every]
    base_column = F.array(*map(F.lit, base))

    # Sums of all keys come from one table of the keys that occur together, in SALTS parts: it is small beside the rows,
    # and rows of a frequent host are joined with its parts, not in one task.
    together = ["host", "declared", "suffix", "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_grams"), F.lit(SALTS)).cast("int"))
    parts = written(_sums(rows, together, "own", width).withColumn("domain", domain(F.col("host"))), "keys")
    keyed, n_parts = parts.drop("sums"), parts.count()
    for key in ("host", "domain", "declared", "suffix"):
        of_key = _sums(parts.where(F.col(key).isNotNull()), [key], "sums", width, F.count("*").alias("n_parts")).withColumnRenamed("sums", f"of_{key}")
        keyed = met(keyed, of_key, key, f"of_{key}", "n_parts", n_parts, F.xxhash64(*together))
    keyed = keyed.select(*[F.col(k).alias(f"k_{k}") for k in together], *[f"of_{k}" for k in ("host", "domain", "declared", "suffix")])
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in together]
    out = rows.join(keyed, same[0] & same[1] & same[2] & same[3]).drop(*[f"k_{k}" for k in together])

    without_own = lambda c: F.zip_with(F.coalesce(F.col(c), F.col("own")), "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    for key, above in (("domain", base_column), ("host", F.col("p_domain"))):
        rest = without_own(f"of_{key}")
        out = out.withColumn(f"rest_{key}", rest)
        out = out.withColumn(f"p_{key}", _smoothed(f"rest_{key}", above))
    # P(declared | language): that key's share of the language's documents, smoothed by the key's own frequency
    logs = F.zip_with("likely", "p_host", lambda a, p: a + F.log(p))
    for key in ("declared", "suffix"):
        rest = without_own(f"of_{key}")
        out = out.withColumn(f"rest_{key}", rest).withColumn(f"n_{key}", _total(F.col(f"rest_{key}")))
        common = (F.col(f"n_{key}") + 1) / F.lit(total + 1)
        out = out.withColumn(f"l_{key}", F.when(F.col(key).isNotNull(), _shares(f"rest_{key}", common, base, total)).otherwise(zeros))
        logs = F.zip_with(logs, f"l_{key}", lambda a, b: a + b)
    out = out.withColumn("posteriors", _normal(logs)).withColumn("best", F.array_max("posteriors"))
    pick = lambda of, top: F.element_at(names, F.array_position(of, top).cast("int"))
    lettered = F.col("n_grams") > 0
    language = F.when(lettered, pick(F.col("posteriors"), F.col("best")))
    return out.select(
        "doc_id",
        language.alias("language"),
        F.when(lettered, F.round("best", 6)).otherwise(0.0).alias("posterior"),
        F.when(lettered, pick(F.col("likely"), F.array_max("likely"))).alias("text_language"),
        (language.isNotNull() & (F.col("best") >= LEAST_POSTERIOR)).alias("accepted"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """The evidence of the documents table: `lang` is what was declared, `source` the host; there is no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """The evidence of web pages: the markup's lang, the address's top-level domain and first path part, and its host."""
    html, url = F.col("html"), F.col("url")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    part = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-z]{2}(?:-[A-Za-z]{2})?)/", 1)
    suffix = F.concat_ws("/", F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lower(part))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    empty = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), empty(declared).alias("declared"), F.when(host != "", suffix).alias("suffix"), empty(host).alias("host"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that identified() accepts; rows without doc_id stay. Columns beside the known ones may have any names."""
    # Written before it is filtered: a filter would be moved below the projections, and repeat their work in each of its terms.
    judged = written(identified(from_documents(docs)).select("doc_id", "accepted"), "judged")
    out = written(judged.where("not accepted and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, "doc_id", "left_anti").select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, posterior, text_language and accepted of every row of documents, as identified() has them; other columns are not read."""
    return identified(from_documents(table(spark, sf_dir, "documents")))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on web pages, where markup and address are evidence too."""
    return identified(from_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")
