"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its bytes, A to Z in lower case, and an end symbol. A byte is eight binary decisions; each has a tree of contexts of
0 to DEPTH bytes before it. A node's Krichevsky-Trofimov estimate and the product of its children's weighted probabilities
are mixed half and half, so what the corpus says decides at which depths to trust a context. A context that training never
met predicts as the deepest one that it met.

Nothing of the model is small, so nothing of it is broadcast but the two shallowest depths (256 contexts). Documents are
taken in blocks. A block gives out its distinct contexts with bytes, and its distinct words, with their training counts; these
are summed over all blocks, weighted in subtrees of two context bytes, and what a block asked for goes back to it by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import _LOWER, U64, chunked, discard, release, table, word_hashes, written

#: Context bytes; a context and the byte after it fit in 40 bits, the byte before last.
DEPTH = 4
#: Ends a text: a byte that UTF-8 never has.
END = 0xFF
#: Bytes of text of a block, and positions that are counted or looked up at a time.
BLOCK_BYTES, WINDOW = 32 << 20, 1 << 18
#: Contexts with bytes that a task weighs at least before the next one; one subtree has up to 256 ** 3.
TASK_GRAMS = 1 << 20
#: Partitions that blocks are scored in, unless the session asks for more.
MOST_PARTS = 20_000
#: Stored blocks hold all texts and keys; packed by this they take two thirds of what the default takes.
CODEC = "zstd"
#: Entries of a counter that aren't merged yet.
LOOSE = 4 << 20
GRAM, WORD = 0, 1
#: Stands for the end among the words.
END_WORD = 0

BLOCKS = "block bigint, kind int, keys array<bigint>, counts array<bigint>, doc_id bigint, held_out boolean, text string"
KEYS_A_ROW = 1 << 16


class Counts:
    """Distinct 64-bit keys and how often they were added."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.loose += len(self.parts[-1][0])
            if self.loose > LOOSE:
                self.parts, self.loose = [self.merged()], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def grams(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, the texts they are of) of all positions of texts, a window at a time; bytes before a text count as zeros."""
    full = np.insert(_LOWER[buf], offs[1:], END)
    at = offs + np.arange(len(offs))
    for lo in range(0, len(full), WINDOW):
        hi = min(lo + WINDOW, len(full))
        place = np.arange(lo, hi)
        owner = np.searchsorted(at, place, side="right") - 1
        since = place - at[owner]
        keys = full[lo:hi].astype(np.int64)
        for j in range(1, DEPTH + 1):
            before = full[np.maximum(place - j, 0)].astype(np.int64)
            before[since < j] = 0
            keys |= before << (8 * (DEPTH + 1 - j))
        yield keys, owner


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, each text followed by END_WORD, and where each text's begin (and the end)."""
    h, at = word_hashes(buf, offs) if len(buf) else (np.zeros(0, dtype=U64), np.zeros(len(offs), dtype=np.int64))
    return np.insert(h.view(np.int64), at[1:], END_WORD), at + np.arange(len(at))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, held_out, text) by block, and each block's distinct keys with their counts in rows that aren't held out."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = (TaskContext.get().partitionId() << 24), 0
        found = {(kind, held): Counts() for kind in (GRAM, WORD) for held in (False, True)}
        for batch in batches:
            text = batch.column(2)
            for lo, hi, buf, offs in chunked(text):
                held = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), dtype=bool)
                for keys, owner in grams(buf, offs):
                    for side in (False, True):
                        found[GRAM, side].add(keys[held[owner] == side])
                words, at = tokens(buf, offs)
                side = np.repeat(held, np.diff(at))
                for of in (False, True):
                    found[WORD, of].add(words[side == of])
                yield _rows(block, hi - lo, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), text.slice(lo, hi - lo))
                size += len(buf) + hi - lo
                if size >= block_bytes:
                    yield from _asked(block, found)
                    block, size = block + 1, 0
        if size:
            yield from _asked(block, found)
        release()

    return docs.mapInArrow(gather, BLOCKS)


def _rows(block: int, n: int, doc_id: pa.Array, held: pa.Array, text: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), doc_id, held, text]
    return pa.RecordBatch.from_arrays(columns, names=[c.strip().split(" ")[0] for c in BLOCKS.split(",")])


def _asked(block: int, found: dict[tuple[int, bool], Counts]) -> Iterator[pa.RecordBatch]:
    """The counters' keys as rows; the counters are emptied."""
    for kind in (GRAM, WORD):
        (keys, n), (others, _) = found[kind, False].merged(), found[kind, True].merged()
        keys, n = summed(np.concatenate([keys, others]), np.concatenate([n, np.zeros(len(others), dtype=np.int64)]))
        found[kind, False], found[kind, True] = Counts(), Counts()
        cuts = np.append(np.arange(0, len(keys), KEYS_A_ROW), len(keys)).astype(np.int32)
        rows = len(cuts) - 1
        columns = [pa.array(np.full(rows, block)), pa.array(np.full(rows, kind, dtype=np.int32)), *(pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (keys, n))]
        columns += [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.strip().split(" ")[0] for c in BLOCKS.split(",")])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by Stirling's series eight steps further on."""
    z, below = x + 8.0, np.ones_like(x)
    for i in range(8):
        below = below * (x + i)
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(below)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """The nodes of one depth and bit: ids (context, then the bits so far), counts, weighted probability and KT's share."""

    ids: np.ndarray
    ones: np.ndarray
    n: np.ndarray
    log_weighted: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray, bit: int, children: np.ndarray | None) -> Level:
        """Of sorted (context, byte) keys. children: ln of the children's product by node, None at the greatest depth."""
        node = keys >> (8 - bit)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, dtype=np.int64)
        every, ones = (np.add.reduceat(x, first) if len(first) else x[:0] for x in (n, n * ((keys >> (7 - bit)) & 1)))
        own = log_kt((every - ones).astype(float), ones.astype(float))
        if children is None:
            return Level(node[first], ones, every, own, np.ones(len(first)))
        weighted = np.logaddexp(own, children) - np.log(2)
        return Level(node[first], ones, every, np.where(every > 0, weighted, 0.0), np.exp(own - np.logaddexp(own, children)))

    def mixed(self, keys: np.ndarray, bit: int, deeper: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each key's bit, given that of the deeper contexts where they were met."""
        at = np.searchsorted(self.ids, keys >> (8 - bit))
        n, ones = self.n[at], self.ones[at]
        own = (np.where((keys >> (7 - bit)) & 1, ones, n - ones) + 0.5) / (n + 1)
        both = np.where(met, self.share[at] * own + (1 - self.share[at]) * deeper, own)
        return np.where(n > 0, both, deeper), met | (n > 0)


def child_sums(below: Level, ids: np.ndarray, bit: int) -> np.ndarray:
    """ln of the product of the children's weighted probabilities, for the nodes `ids` of the depth above."""
    of = ((below.ids >> (bit + 8)) << bit) | (below.ids & ((1 << bit) - 1))
    return np.bincount(np.searchsorted(ids, of), weights=below.log_weighted, minlength=len(ids))


def at_depth(keys: np.ndarray, depth: int) -> np.ndarray:
    """(context of so many bytes, byte) of full keys."""
    return ((keys >> (8 * (DEPTH + 1 - depth))) << 8) | (keys & 0xFF)


@dataclass
class Subtrees:
    """Contexts of two bytes or more with all their descendants."""

    keys: np.ndarray
    levels: dict[tuple[int, int], Level]

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray, shallowest: int = 2) -> Subtrees:
        levels: dict[tuple[int, int], Level] = {}
        for depth in range(DEPTH, shallowest - 1, -1):
            own, m = summed(at_depth(keys, depth), n)
            for bit in range(8):
                node = own >> (8 - bit)
                ids = node[np.concatenate([[True], node[1:] != node[:-1]])] if len(node) else node
                levels[depth, bit] = Level.of(own, m, bit, child_sums(levels[depth + 1, bit], ids, bit) if depth < DEPTH else None)
        return Subtrees(keys, levels)

    def log10(self, top: Subtrees) -> np.ndarray:
        """log10 of each key's probability, given the levels of depths 1 and 0."""
        total = np.zeros(len(self.keys))
        for bit in range(8):
            p, met = np.full(len(self.keys), 0.5), np.zeros(len(self.keys), dtype=bool)
            for depth in range(DEPTH, -1, -1):
                p, met = (self.levels if depth > 1 else top.levels)[depth, bit].mixed(at_depth(self.keys, depth), bit, p, met)
            total += np.log10(p)
        return total


def top_of(keys: np.ndarray, n: np.ndarray, sums: dict[tuple[int, int], float]) -> Subtrees:
    """Depths 1 and 0 from the counts of (context byte, byte), and the products below by (bit, node of depth 1)."""
    levels: dict[tuple[int, int], Level] = {}
    for bit in range(8):
        ids = np.unique(keys >> (8 - bit))
        levels[1, bit] = Level.of(keys, n, bit, np.array([sums.get((bit, i), 0.0) for i in ids.tolist()]))
        own, m = summed(keys & 0xFF, n)
        levels[0, bit] = Level.of(own, m, bit, child_sums(levels[1, bit], np.unique(own >> (8 - bit)), bit))
    return Subtrees(keys, levels)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of a task, in order of keys."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def gram_scores(counted: DataFrame) -> DataFrame:
    """key and value (log10 of its probability) of each of counted(key, n), a row for each context with a byte.

    At most 65,536 counts and as many sums come to the driver, for depths 1 and 0.
    """
    spark = counted.sparkSession
    n_keys = counted.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // TASK_GRAMS))
    dealt = counted.select("key", "n").repartition(parts, F.shiftright("key", 8 * (DEPTH - 1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Subtrees.of(*_whole(batches))
        for bit in range(8):
            level = tree.levels[2, bit]
            above = ((level.ids >> (bit + 8)) << bit) | (level.ids & ((1 << bit) - 1))
            ids, where = np.unique(above, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bit, dtype=np.int32)), pa.array(ids), pa.array(np.bincount(where, weights=level.log_weighted, minlength=len(ids)))], names=["bit", "node", "total"])
        release()

    below = {(r.bit, r.node): r.total for r in dealt.mapInArrow(sums, "bit int, node bigint, total double").groupBy("bit", "node").agg(F.sum("total").alias("total")).collect()}
    short = F.shiftleft(F.shiftright("key", 8 * DEPTH), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFF))).alias("short")
    pairs = sorted((r.short, r.n) for r in counted.groupBy(short).agg(F.sum("n").alias("n")).collect())
    top = spark.sparkContext.broadcast(top_of(np.array([k for k, _ in pairs], dtype=np.int64), np.array([n for _, n in pairs], dtype=np.int64), below))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Subtrees.of(*_whole(batches))
        if len(tree.keys):
            yield pa.RecordBatch.from_arrays([pa.array(tree.keys), pa.array(tree.log10(top.value))], names=["key", "value"])
        release()

    return dealt.mapInArrow(values, "key bigint, value double")


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row of docs(doc_id, held_out, text).

    The model learns from all rows that aren't held out. score is log10 of the probability of the bytes and the end,
    bits_per_byte its code length in bits over the bytes with the end; base_score is that of the smoothed word counts. Null
    and empty texts are the end alone, null held_out counts as false, null ids and repeated rows are rows like any other.
    Without training rows every decision has probability 1/2.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    stored = written(blocks(rows, block_bytes), "blocks", CODEC)
    each = stored.where("kind is not null").select("block", "kind", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("block", "kind", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    totals = written(each.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals", CODEC)
    words = totals.where(F.col("kind") == WORD)
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    found = gram_scores(totals.where(F.col("kind") == GRAM)).select(F.lit(GRAM).alias("kind"), "key", "value")
    values = written(found.unionByName(words.select("kind", "key", F.col("n").cast("double").alias("value"))), "values", CODEC)
    discard(totals)
    # exploded rows are many more than their files' size tells, so neither side is to be broadcast
    answers = each.select("block", "kind", "key").join(values.hint("merge"), ["kind", "key"]).select("block", "kind", "key", "value")

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = {}
        kind = answers["kind"].to_numpy()
        key, value = answers["key"].to_numpy(), answers["value"].to_numpy()
        for k in (GRAM, WORD):
            own, v = key[kind == k], value[kind == k]
            order = np.argsort(own)
            known[k] = own[order], v[order]
        out = [_scored(b, known, train_tokens, distinct) for b in texts.to_batches()]
        release()
        return pa.Table.from_batches(out)

    held = stored.where("kind is null").select(F.col("block").alias("of_block"), "doc_id", "held_out", "text")
    # several partitions for each block, as long as that isn't many, so that few tasks get two
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, 4 * stored.select("block").distinct().count()))
    return held.repartition(parts, "of_block").groupBy("of_block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(score, SCORES)


def _looked_up(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(keys, return_inverse=True)
    at = np.searchsorted(known[0], distinct)
    if len(distinct) and not np.array_equal(known[0][np.minimum(at, len(known[0]) - 1)], distinct):
        raise ValueError("a block's documents hold keys that it didn't ask for")
    return known[1][at][back]


def _scored(batch: pa.RecordBatch, known: dict[int, tuple[np.ndarray, np.ndarray]], train_tokens: int, distinct: int) -> pa.RecordBatch:
    total, base, n_tokens, n_known, n_bytes = np.zeros(batch.num_rows), np.zeros(batch.num_rows), *np.zeros((3, batch.num_rows), dtype=np.int64)
    for lo, hi, buf, offs in chunked(batch.column("text")):
        for keys, owner in grams(buf, offs):
            total[lo:hi] += np.bincount(owner, weights=_looked_up(known[GRAM], keys), minlength=hi - lo)
        words, at = tokens(buf, offs)
        counts = _looked_up(known[WORD], words)
        base[lo:hi] = np.add.reduceat(np.log10((counts + 1) / (train_tokens + 1 * (distinct + 1))), at[:-1])
        n_tokens[lo:hi], n_known[lo:hi], n_bytes[lo:hi] = np.diff(at), np.add.reduceat(counts > 0, at[:-1], dtype=np.int64), np.diff(offs)
    columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(x) for x in (n_tokens, n_known, np.full(batch.num_rows, train_tokens), base, total, n_bytes, -total * np.log2(10) / (n_bytes + 1)))]
    return pa.RecordBatch.from_arrays(columns, names=[c.strip().split(" ")[0] for c in SCORES.split(",")])


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() of every row of documents; rows whose CRC-32 of doc_id as text (null: empty) leaves 2 modulo 7 are held out.

    Nulls, repeats and empty tables as in scores(); other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return scores(docs.select("doc_id", (F.crc32(name) % 7 == 2).alias("held_out"), "text"))
