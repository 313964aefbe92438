"""Near-duplicate classes by banded MinHash with odd sketches, confirmed on full shingle sets.

Documents with equal shingle sets form a class at once. Class representatives get MinHash samples; bands of
them make buckets, and all samples are folded into a parity bitmap (odd sketch), whose XOR population count
estimates high similarities. In each round a bucket's members are compared with its leader only, so pairs
grow with the members and not with their square. Buckets whose members are then still in different components are
cut into tiles, and two tiles are compared in one task, which gives out only links. Every pair that passes its sketch is
confirmed by comparing the full sets, unless links have joined its components already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import U64, chunked, discard, distinct_in_text, lists, met, mix, shingle_hashes, table, word_hashes, written
from attestor.llm.components import components

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
#: Chance that a pair at the threshold shares no band, and bands at which rows a band stop growing.
MISS, BANDS_MOST = 4e-7, 32
#: Samples that the odd sketch folds (the bands use the first of them), its bits, and the standard errors by which a pair's
#: sketches may differ more than at the threshold.
SAMPLES, SKETCH_BITS, ERRORS = 224, 1024, 5.5
LEADER_ROUNDS = 2
#: Members of a bucket that are compared with one another in one go; larger buckets are cut into tiles of this size.
#: So is one whose sets hold more shingles than this for each of its tiles.
TILE, TILE_SHINGLES = 512, 4 << 20
#: Parts that documents of one shingle set are dealt over.
SALTS = 32
#: Ids of so many documents at most are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(977)
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(U64)
_FOLD = mix(np.arange(1, SAMPLES + 1, dtype=U64))


@dataclass(frozen=True)
class Cuts:
    """What a threshold asks for: bands, rows a band, and the XOR count up to which sketches agree."""

    bands: int
    rows: int
    differ: int

    @staticmethod
    def of(percent: int) -> Cuts:
        """As many rows a band as BANDS_MOST bands allow; ValueError unless percent is from 10 to 100."""
        if not 10 <= percent <= 100:
            raise ValueError(f"percent must be from 10 to 100, not {percent}")
        s = percent / 100
        need = lambda r: 1 if s == 1 else ceil(log(MISS) / log1p(-(s**r)))
        rows = max((r for r in range(1, 9) if need(r) <= BANDS_MOST and r * need(r) <= SAMPLES), default=1)
        apart = min(SAMPLES, SAMPLES * (1 - s) + ERRORS * sqrt(SAMPLES * s * (1 - s)))
        return Cuts(need(rows), rows, ceil(SKETCH_BITS / 2 * (1 - exp(-4 * apart / SKETCH_BITS))))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def samples(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples of each non-empty set: a row for each hash function."""
    out = np.empty((len(_A), len(bounds) - 1), dtype=U64)
    for i in range(len(_A)):
        out[i] = np.minimum.reduceat(h * _A[i] + _B[i], bounds[:-1])
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: SKETCH_BITS / 64 words for each set."""
    n = mins.shape[1]
    bits = np.zeros((n, SKETCH_BITS), dtype=np.uint8)
    every = np.arange(n)
    for i in range(len(mins)):
        bits[every, (mix(mins[i] + _FOLD[i]) >> U64(40)).astype(np.int64) % SKETCH_BITS] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(U64)


def bands(mins: np.ndarray, cuts: Cuts) -> np.ndarray:
    """A 64-bit key for each set and band."""
    keys = np.empty((mins.shape[1], cuts.bands), dtype=U64)
    for b in range(cuts.bands):
        key = np.full(mins.shape[1], b + 1, dtype=U64)
        for r in range(cuts.rows):
            key = mix(key * U64(0xE7037ED1A0B428DB) + mins[b * cuts.rows + r])
        keys[:, b] = key
    return keys


def signatures(docs: DataFrame, k: int, cuts: Cuts) -> DataFrame:
    """doc_id, n_shingles, two sums that name the shingle set, band keys and the sketch of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunked(batch.column(1)):
                h, bounds = distinct_in_text(*shingle_hashes(*word_hashes(buf, offs), k))
                n = np.diff(bounds)
                full = n > 0
                sums = np.zeros((2, hi - lo), dtype=U64)
                keys, sketch = np.zeros((0, cuts.bands), dtype=U64), np.zeros((0, SKETCH_BITS // 64), dtype=U64)
                if full.any():
                    packed = np.concatenate([[0], np.cumsum(n[full])])
                    sums[0, full] = np.add.reduceat(h, packed[:-1])
                    sums[1, full] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), packed[:-1])
                    mins = samples(h, packed)
                    keys, sketch = bands(mins, cuts), odd_sketches(mins)
                at = np.concatenate([[0], np.cumsum(full)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), lists(_signed(keys.ravel()), at * cuts.bands, pa.int64()), lists(_signed(sketch.ravel()), at * (SKETCH_BITS // 64), pa.int64())],
                    names=["doc_id", "n_shingles", "name_a", "name_b", "keys", "sketch"],
                )

    return docs.mapInArrow(sign, "doc_id bigint, n_shingles bigint, name_a bigint, name_b bigint, keys array<bigint>, sketch array<bigint>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of each row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunked(batch.column(1)):
                h, bounds = distinct_in_text(*shingle_hashes(*word_hashes(buf, offs), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(_signed(h), bounds, pa.int64())], names=["doc_id", "shingles"])

    return docs.mapInArrow(sets, "doc_id bigint, shingles array<bigint>")


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids(doc_id), which is broadcast if its counted rows are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _similar(n_a: str, n_b: str, percent: int):
    """Whether the sizes allow the threshold."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _agree(percent: int) -> Column:
    """Whether sizes and sketches of both sides of a join allow the threshold."""
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("head_sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return _similar("n_shingles", "head_n", percent) & (differ <= Cuts.of(percent).differ)


def led_pairs(rows: DataFrame, reps: DataFrame, turn: int, percent: int) -> DataFrame:
    """u, v, n_u, n_v of each bucket's members and its leader, where sizes and sketches agree and components differ.

    A member's draw decides who leads: its own at first, so that overlapping buckets have one leader, and then also the
    bucket's, so that a member meets many.
    """
    draw = F.xxhash64(F.lit(turn), "rep", "bucket") if turn else F.xxhash64("rep")
    least = F.min(F.struct(draw.alias("draw"), "rep", "component"))
    led = rows.groupBy("bucket").agg(least.alias("leader"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low <> high")
    led = led.select("bucket", "members", F.col("leader.rep").alias("head"), F.col("leader.component").alias("of_head"))
    led = led.join(reps.select(F.col("rep").alias("head"), F.col("n_shingles").alias("head_n"), F.col("sketch").alias("head_sketch")), "head")
    led = led.select("bucket", "members", F.struct("head", "of_head", "head_n", "head_sketch").alias("led"))
    near = met(rows.drop("members"), led, "bucket", "led", "members", rows.count(), F.xxhash64("rep", "bucket")).where("led is not null")
    near = near.select("rep", "component", "n_shingles", "sketch", "led.*").where((F.col("component") != F.col("of_head")) & _agree(percent))
    first = F.col("rep") < F.col("head")
    sizes = [F.when(first, a).otherwise(b).alias(name) for a, b, name in ((F.col("n_shingles"), F.col("head_n"), "n_u"), (F.col("head_n"), F.col("n_shingles"), "n_v"))]
    return near.select(*_ordered("rep", "head"), *sizes).distinct()


def confirmed(near: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v, n_u, n_v) whose full sets reach the threshold."""
    ids = written(near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct(), "ids")
    sets = written(shingle_sets(_with_ids(docs, ids), k), "sets")
    both = near.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    out = written(both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("shared")) * percent).select("u", "v"), "confirmed")
    discard(ids, sets)
    return out


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


_TILE = "bucket bigint, low int, high int, tile int, rep bigint, component bigint, n_shingles bigint, sketch array<bigint>, keys array<bigint>"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "tile", "rep")


def tiled_links(rows: DataFrame, docs: DataFrame, k: int, percent: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) among rows(bucket, members, total, rep, component, n_shingles, sketch, keys) of one bucket and different components.

    A bucket of m members is cut into m / tile tiles, more if their sets hold many shingles (total). Each row goes to every pair of tiles that its own is part of, and
    a task compares two tiles at a time, so its memory is bounded by the tile and a bucket is spread over many tasks. A
    first pass keeps the rows whose sketch agrees with another's; these get their full sets, and a second pass confirms
    the agreeing pairs, the likeliest first, leaving out those that earlier links of the tile have joined. So links are
    fewer than rows, and no pair of components that are linked is lost. A pair that shares several buckets is taken in the first.
    """
    tiles = F.ceil(F.greatest(F.col("members") / tile, F.col("total") / TILE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    cut = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    cut = cut.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    columns = [c.strip().split(" ")[0] for c in _TILE.split(",")]
    agreeing = written(_dealt(cut.select(*columns)).mapInArrow(lambda batches: _by_tile(batches, _agreeing_rows, percent), _TILE), "agreeing")
    ids = written(agreeing.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = written(shingle_sets(_with_ids(docs, ids), k), "sets")
    full = agreeing.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(*columns, "shingles")
    out = written(_dealt(full).mapInArrow(lambda batches: _by_tile(batches, _tile_links, percent), "u bigint, v bigint").distinct(), "tiled")
    discard(agreeing, ids, sets)
    return out


def _by_tile(batches: Iterator[pa.RecordBatch], each, percent: int) -> Iterator[pa.RecordBatch]:
    """each(rows, percent) for each run of equal (bucket, low, high); a run may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        cuts = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and tuple(key[lo]) != last:
                yield each(pa.Table.from_batches(held).combine_chunks(), percent)
                held = []
            last = tuple(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield each(pa.Table.from_batches(held).combine_chunks(), percent)


def _agreeing_pairs(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a tile that agree, and how far their sketches differ."""
    most = Cuts.of(percent).differ
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    bucket = np.int64(rows["bucket"][0].as_py())
    tile, rep, component, n = (rows[c].to_numpy().astype(np.int64) for c in ("tile", "rep", "component", "n_shingles"))
    sketch, keys = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1) for c in ("sketch", "keys"))
    sketch = sketch.view(U64)
    band = (keys == bucket).argmax(axis=1)
    a = np.flatnonzero(tile == low)
    b = a if low == high else np.flatnonzero(tile == high)
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for i in range(0, len(a), 64):  # bounds the matrix of differences
        own = a[i : i + 64]
        small, large = np.minimum(n[own][:, None], n[b]), np.maximum(n[own][:, None], n[b])
        ok = (small * 100 >= large * percent) & (component[own][:, None] != component[b])
        if b is a:
            ok &= rep[own][:, None] < rep[b]
        x, y = np.nonzero(ok)
        for j in range(0, len(x), 1 << 14):
            u, v = own[x[j : j + (1 << 14)]], b[y[j : j + (1 << 14)]]
            differ = np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1, dtype=np.int64)
            near = differ <= most
            u, v, differ = u[near], v[near], differ[near]
            first = (keys[u] == keys[v]).argmax(axis=1) == band[u]
            found.append((u[first], v[first], differ[first]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _agreeing_rows(rows: pa.Table, percent: int) -> pa.RecordBatch:
    u, v, _ = _agreeing_pairs(rows, percent)
    kept = rows.take(pa.array(np.unique(np.concatenate([u, v])))).combine_chunks()
    return pa.RecordBatch.from_arrays([kept[c].combine_chunks() for c in kept.column_names], names=kept.column_names)


def _tile_links(rows: pa.Table, percent: int) -> pa.RecordBatch:
    u, v, differ = _agreeing_pairs(rows, percent)
    rep, component = (rows[c].to_numpy().tolist() for c in ("rep", "component"))
    shingles = rows["shingles"].combine_chunks()
    at, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    links = []
    for i in np.argsort(differ, kind="stable").tolist():
        x, y = find(component[u[i]]), find(component[v[i]])
        if x == y:
            continue
        p, q = flat[at[u[i]] : at[u[i] + 1]], flat[at[v[i]] : at[v[i] + 1]]
        both = len(p) + len(q) - len(np.union1d(p, q))
        if 100 * both >= percent * (len(p) + len(q) - both):
            root[max(x, y)] = min(x, y)
            links.append(sorted((rep[u[i]], rep[v[i]])))
    return pa.RecordBatch.from_arrays([pa.array([z[j] for z in links], type=pa.int64()) for j in (0, 1)], names=["u", "v"])


def classes(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs(doc_id, text).

    component_id is the smallest doc_id reached by links, kept marks that document. A text without words, or
    null, is in a component of its own. A row without doc_id takes part in no link; its component_id is null and
    it is kept. Rows that repeat a doc_id share a component.
    """
    cuts = Cuts.of(percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where("doc_id is not null")
    salted = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    signed = written(signatures(docs, k, cuts).withColumn("salt", salted), "signatures")
    named = ["n_shingles", "name_a", "name_b"]
    # Copies are counted in parts, so that no task has all documents of one set.
    parts = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*named, "salt").agg(F.min("doc_id").alias("rep"))
    sets = parts.groupBy(*named).agg(F.min("rep").alias("rep"))
    reps = signed.join(sets.select(F.col("rep").alias("doc_id"), *[F.col(c).alias(f"of_{c}") for c in named]), "doc_id")
    reps = written(reps.where(" and ".join(f"{c} = of_{c}" for c in named)).select(F.col("doc_id").alias("rep"), "n_shingles", "sketch", "keys").dropDuplicates(["rep", "n_shingles"]), "reps")

    rows = reps.select("rep", "n_shingles", F.explode("keys").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).where("members > 1")
    shared = written(shared.select("bucket", "members", F.struct("members", "total").alias("of_bucket")), "shared")
    rows = met(rows.select("rep", "bucket"), shared, "bucket", "of_bucket", "members", reps.count() * cuts.bands, F.xxhash64("rep", "bucket"))
    rows = rows.where("of_bucket is not null").select("rep", "bucket", "of_bucket.*").join(reps.select("rep", "n_shingles", "sketch"), "rep")
    rows = written(rows.select("bucket", "members", "total", "rep", "n_shingles", "sketch"), "buckets")
    discard(shared)
    links, found = None, None
    for turn in range(LEADER_ROUNDS):
        near = written(led_pairs(_placed(rows, found), reps, turn, percent), "near")
        if found is None or not near.isEmpty():
            links, found = _linked(links, confirmed(near, known, k, percent))
        discard(near)

    placed = _placed(rows.where("members > 2"), found)
    live = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_open")).where("low <> high").select("bucket", "n_open", F.lit(True).alias("live"))
    open_rows = met(placed, live, "bucket", "live", "n_open", rows.count(), F.xxhash64("rep", "bucket")).where("live").drop("live").join(reps.select("rep", "keys"), "rep")
    links, found = _linked(links, tiled_links(open_rows, known, k, percent))
    discard(rows, reps, links)

    placed = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*named, F.coalesce("component", "rep").alias("of_set"))
    placed = parts.select(*named, "salt").join(placed, named)
    out = signed.select("doc_id", *named, "salt").join(placed, [*named, "salt"], "left").withColumn("component_id", F.coalesce("of_set", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _placed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with the component of rep so far."""
    if found is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _linked(links: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far, and the components that they make."""
    both = written(new if links is None else links.union(new), "links")
    discard(new, links)
    return both, components(both)


def deduplicated(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs, with all columns, that classes() keeps: one document of each component.

    Rows without doc_id stay; all rows of a kept doc_id stay, repeats too. A doc_id that has a row to drop goes with all of them.
    Columns beside doc_id and text may have any names.
    """
    out = written(classes(docs, k, percent).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, "doc_id", "left_anti").select(*docs.columns)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents, as classes() has them, on four-word shingles; other columns are not read."""
    return classes(table(spark, sf_dir, "documents"), k=4)
