"""Token files, shards, audio and packing: exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus_cases import ODD, sentence
from pyspark.sql import functions as F

from attestor.llm import audio, encoding, packing, sharding, token_orc

vocabularies = pytest.importorskip("public_tokenizers")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabularies.path(name))


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_memoised_encoding_equals_the_library(name, kind):
    import pyarrow as pa

    rng = random.Random(4)
    alphabet = "aàÀé ßñ.,!?'0129\n\t  \r_-<|>İ中́\x85\xa0#$%"
    texts = [*ODD, *("".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000))]
    encoder, plain = encoding.Encoder(vocabularies.path(name), kind), library(name)
    got = [None] * len(texts)
    for lo, hi, ids, at in encoder.encode(pa.array(texts)):
        for i in range(lo, hi):
            got[i] = ids[at[i - lo] : at[i - lo + 1]].tolist()
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def mirrored(n):
    """Two words of n bytes that any polynomial hash modulo a power of two takes for one: the Thue-Morse word and its complement."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@pytest.mark.parametrize("broken", [False, True])
def test_words_of_equal_hash_keep_their_ids(monkeypatch, name, kind, broken):
    import pyarrow as pa

    if broken:  # even if all hashes of a length were equal
        monkeypatch.setattr(encoding, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    texts = [*mirrored(2048), "ab ba abab baba", " ".join(mirrored(512)), *mirrored(16)]
    encoder, plain, got = encoding.Encoder(vocabularies.path(name), kind), library(name), []
    for _ in range(2):
        got = [ids[at[i] : at[i + 1]].tolist() for lo, hi, ids, at in encoder.encode(pa.array(texts)) for i in range(hi - lo)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_span_hashes_tell_spans_apart():
    from attestor.llm import common

    rng = random.Random(3)
    spans = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(4000)] + [w.encode() for n in (8, 64, 256, 257, 2048) for w in mirrored(n)] + [b"a", b"a\0", b"\0", b"\0\0"]
    buf = np.frombuffer(b"".join(spans), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    h = common.span_hashes(buf, ends - [len(x) for x in spans], ends)
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(h.tolist(), spans, strict=True)))


def test_a_full_cache_starts_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encoding, "CACHE_WORDS", {"byte": 50})
    encoder, plain = encoding.Encoder(vocabularies.path("byte_bpe_50k.json"), "byte"), library("byte_bpe_50k.json")
    for seed in range(5):
        text = sentence(seed, 60)
        [(_, _, ids, _)] = encoder.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_op1(spark, corpus):
    rows = {r.doc_id: r for r in token_orc.op1_token_orc(spark, corpus(ODD)).collect()}
    plain, start = library("byte_bpe_50k.json"), 0
    for i, t in enumerate(ODD):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_orc.op1_token_orc(spark, corpus([])).count() == 0


def test_op1_starts_follow_the_files(spark, corpus, monkeypatch, tmp_path):
    """Also where ids repeat or are null: each row's ids lie at its start among all ids of the files in order."""
    monkeypatch.setattr(token_orc, "scratch", lambda spark, name: str(tmp_path / name))
    extra = [(3, sentence(i, 5 + i), "en", "x", 1) for i in range(40)] + [(None, sentence(i, 3), None, None, None) for i in range(10)] + [(3, "same", "en", "x", 1)] * 3
    rows = token_orc.op1_token_orc(spark, corpus(ODD, extra=extra)).collect()
    files = sorted((tmp_path / "tokens").glob("*.orc"))
    held = [r for f in files for r in spark.read.schema(token_orc.FILE_SCHEMA).orc(str(f)).collect()]
    assert [(r.doc_id is not None, r.doc_id or 0, r.text_hash) for r in held] == sorted((r.doc_id is not None, r.doc_id or 0, r.text_hash) for r in held)
    want, start = [], 0
    for r in held:
        want.append((str(r.doc_id), start, r.n_tokens, zlib.crc32(np.array(r.token_ids, dtype="<u4").tobytes())))
        start += r.n_tokens
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)


def test_token_files_prune_by_id(spark, corpus, tmp_path):
    docs = spark.read.parquet(corpus([sentence(i) for i in range(50)]) + "/documents.parquet")
    token_orc.write_tokens(docs, vocabularies.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    found = token_orc.read_tokens(spark, str(tmp_path / "t"), "doc_id = 7")
    assert found.count() == 1 and "EqualTo(doc_id,7)" in found._jdf.queryExecution().executedPlan().toString()


def test_token_files_have_stripes_row_groups_and_bloom_filters(spark, tmp_path):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(docs, vocabularies.path("byte_bpe_50k.json"), str(tmp_path / "t"), stripe_bytes=1 << 12)
    files = sorted((tmp_path / "t").glob("*.orc"))
    orc = spark._jvm.org.apache.orc.OrcFile
    stripes = 0
    for f in files:
        reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(f)), orc.readerOptions(spark._jsc.hadoopConfiguration()))
        stripes += reader.getStripes().size()
        wanted = spark.sparkContext._gateway.new_array(spark._jvm.boolean, reader.getSchema().getMaximumId() + 1)
        for i in range(len(wanted)):
            wanted[i] = True
        index = reader.rows().readRowIndex(0, None, wanted)
        groups, blooms = index.getRowGroupIndex()[1], index.getBloomFilterIndex()
        assert (reader.getRowIndexStride(), reader.getCompressionKind().toString()) == (1000, "ZSTD")
        assert groups.getEntryCount() == blooms[1].getBloomFilterCount() == -(-reader.getStripes().get(0).getNumberOfRows() // 1000)
        assert blooms[4] is None or not blooms[4].getBloomFilterCount()  # on the token ids there is none
    assert len(files) == 4 and stripes > len(files)


def test_ranges_follow_from_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_orc, "RANGE_BYTES", 2000)
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    token_orc.write_tokens(docs, vocabularies.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.orc"))) >= 9


def shards_of(spark, docs, out, **options):
    sharding.write_shards(docs, out, **options)
    return sharding.read_shards(spark, out, sharding.records(docs).schema["record"].dataType)


def test_op2(spark, corpus):
    texts = [*ODD, *(sentence(i) for i in range(60)), *[sentence(7)] * 30]
    base = corpus(texts, extra=[(None, "no id", None, None, None), (3, "a", "en", "x", 1), (3, "a", "en", "x", 1)])
    rows = sharding.op2_sharding(spark, base).collect()
    assert len(rows) == len(texts) + 3 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    shards = [sorted(r.slot for r in rows if r.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in shards)
    for r in rows:
        if r.doc_id not in (None, 3):
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.op2_sharding(spark, corpus([])).count() == 0


def test_shards_are_of_equal_bytes_and_hold_groups_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BIG_GROUPS", 50)
    rng = random.Random(2)
    texts = [sentence(i, rng.randint(5, 60)) for i in range(3000)]
    texts += [t for i, t in enumerate(texts[:300]) for _ in range(i % 9)] + [sentence(-1, 30)] * 900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards_of(spark, docs, str(tmp_path / "s")).select("record.text", "size", "shard").collect()
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert len(rows) == len(texts) and max(sizes) <= 1.05 * min(sizes)
    homes = {}
    for r in rows:
        homes.setdefault(r.text, set()).add(r.shard)
    assert {t for t, s in homes.items() if len(s) > 1} == {sentence(-1, 30)}  # a group of more than two shards' bytes


def twister(seed):
    """Python's Mersenne Twister, begun like one of a 64-bit seed of two words, the higher first."""
    seed &= (1 << 64) - 1
    return random.Random((seed >> 32) | (seed & 0xFFFFFFFF) << 32 | (1 << 64 if not seed & 0xFFFFFFFF else 0)) if seed & 0xFFFFFFFF else None


def below(rng, n):
    if n & (n - 1) == 0:
        return (n * (rng.getrandbits(32) >> 1)) >> 31
    while True:
        bits = rng.getrandbits(32) >> 1
        if bits - bits % n + n - 1 < 1 << 31:
            return bits % n


def fisher_yates(items, seed):
    """Inside-out: each item takes a drawn place among those before it, whose item moves to the end."""
    rng, out = twister(seed), []
    for i, x in enumerate(items):
        k = below(rng, i + 1)
        out.append(x)
        if k != i:
            out[i], out[k] = out[k], x
    return out


def test_buckets_are_shuffled_by_fisher_yates_of_seed_and_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_BUCKETS", 3)
    docs = sharding.records(spark.createDataFrame([(i, sentence(i, 4)) for i in range(400)], "doc_id long, text string"))
    to, _ = sharding.layout(docs)
    buckets = {}
    for r in sharding.scattered(sharding.numbered(docs, to), to).select("bucket", "draw", "tie", "record.doc_id").collect():
        buckets.setdefault(r.bucket, []).append((r.draw, r.tie, r.doc_id))
    want = {(b, turn): x[2] for b, rows in buckets.items() for turn, x in enumerate(fisher_yates(sorted(rows), to.seed + b))}
    for parts in (1, 5, 13):
        got = sharding.shuffled(docs.repartition(parts, F.rand(parts)), to).select("bucket", "turn", "record.doc_id").collect()
        assert {(r.bucket, r.turn): r.doc_id for r in got} == want


def test_shards_follow_from_seed_and_rows_alone(spark, tmp_path):
    rows = [(i % 90 if i % 7 else None, sentence(i % 50, 8) if i % 11 else None, "x" * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    places = {parts: sorted(map(str, shards_of(spark, docs.repartition(parts, F.rand(parts)), str(tmp_path / f"s{parts}")).collect())) for parts in (1, 4, 9)}
    assert places[1] == places[4] == places[9]
    assert places[1] != sorted(map(str, shards_of(spark, docs, str(tmp_path / "other"), seed=5).collect()))


def test_equal_records_spread_over_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_REPEATED", 20)
    docs = spark.createDataFrame([(1, "same", 5)] * 400 + [(i, sentence(i, 4), i) for i in range(100)], "doc_id long, text string, copy long")
    places = []
    for parts in (2, 7):
        rows = shards_of(spark, docs.repartition(parts, F.rand(parts)), str(tmp_path / f"s{parts}"))
        assert rows.count() == 500 and rows.where("record.text = 'same'").count() == 400
        assert all(r.n == r.most + 1 for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("most")).collect())
        places.append(sorted(map(str, rows.collect())))
    assert places[0] == places[1]
    to, _ = sharding.layout(sharding.records(docs))
    spread = sharding.shuffled(sharding.records(docs), to).where("record.text = 'same'").groupBy("bucket").count().collect()
    assert len(spread) > 30 and max(r["count"] for r in spread) < 40


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    names = ["size", "slot", "shard", "bucket", "draw", "tie", "turn", "row", "rows", "record", "copy", "n", "part", "before", "of_group", "a.b"]
    docs = spark.createDataFrame([(i, f"t{i}", *[12345 + i] * len(names)) for i in range(40)], ["doc_id", "text", *names])
    rows = shards_of(spark, docs, str(tmp_path / "s"))
    assert sorted(tuple(r.record) for r in rows.collect()) == sorted(map(tuple, docs.collect()))


def test_op2_order_is_a_shuffle(spark, corpus):
    rows = sharding.op2_sharding(spark, corpus([sentence(i) for i in range(400)])).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    ups = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert sorted(order) == list(range(400)) and 150 < ups < 250
    means = [np.mean(order[50 * k : 50 * k + 50]) for k in range(8)]
    assert all(130 < m < 270 for m in means)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from attestor.llm import common

    def session(master, folder=None):
        none = SimpleNamespace(isDefined=lambda: False)
        sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=sc)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch(session(master), "x")
    assert common.scratch(session("yarn", "hdfs:///c/"), "x").startswith("hdfs:///c/attestor/x-")
    assert common.scratch(session("local[4]"), "x").startswith("file:///")


def doubled(x):
    """Linear interpolation to twice the rate; the last sample is held."""
    x = [int(v) for v in x]
    return np.array([v for a, b in zip(x, [*x[1:], x[-1]], strict=True) for v in (a, a + (b - a) // 2)], dtype=np.int16)


def test_op9(spark, corpus):
    rows = {r.doc_id: r for r in audio.op9_audio(spark, corpus(ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(audio.wave(payload)), hashlib.sha256(audio.wave(payload)).hexdigest())
    assert rows[9].feature == rows[10].feature


def test_op9_stores_the_pcm_that_it_digests(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(audio, "scratch", lambda spark, name: str(tmp_path / name))
    rows = {r.doc_id: r for r in audio.op9_audio(spark, corpus(ODD)).collect()}
    held = spark.read.parquet(str(tmp_path / "media"))
    stored = {r.doc_id: r for r in audio.restored(held).collect()}
    assert sorted(stored) == list(range(len(ODD)))
    for i, r in stored.items():
        payload = np.frombuffer(audio.parse_wave(bytes(r.media))[3], dtype=np.uint8)
        samples = doubled(audio.MU_TABLE[payload]).astype("<i2").tobytes()
        assert bytes(r.pcm) == audio.wave(samples, audio.PCM, 16000, 2, 16)
        assert rows[i].feature.split(":")[0] == f"{zlib.crc32(samples):08x}"
    other = audio.coded(np.array([1], dtype=np.int16), 16000)
    changed = audio.features(held.withColumn("pcm", F.lit(other))).collect()
    assert {r.feature.split(":")[0] for r in changed} == {f"{zlib.crc32(bytes([1, 0])):08x}"}


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            size = step // 8 + (step // 4 if nibble & 1 else 0) + (step // 2 if nibble & 2 else 0) + (step if nibble & 4 else 0)
            value = max(-32768, min(32767, value - size if nibble & 8 else value + size))
            index = max(0, min(88, index + int(audio.CHANGES[nibble & 7])))
            out.append(value)
    return out


def test_decoders():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (20, 64), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]
    # values of G.711: the smallest and largest codes of either sign
    assert [int(audio.MU_TABLE[c]) for c in (0x00, 0x80, 0x7F, 0xFF, 0x8F)] == [-32124, 32124, 0, 0, 16764]
    assert [int(audio.A_TABLE[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    x = rng.integers(-30000, 30000, 100).astype(np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == doubled(x).tolist()
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist()


def test_feature_is_what_its_parts_say(spark, corpus):
    """Every part of `feature`, by plain loops over the payload."""
    texts = ["abc", sentence(4, 60), "é" * 70, None]
    for r in audio.op9_audio(spark, corpus(texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        mu, a = ([int(t[b]) for b in raw] for t in (audio.MU_TABLE, audio.A_TABLE))
        adpcm = [v for i in range(0, len(raw), 64) for v in plain_adpcm(raw[i : i + 64])]
        crcs = [zlib.crc32(np.array(v, dtype="<i2").tobytes()) for v in (doubled(mu), a, adpcm)]
        root, peak = int((sum(v * v for v in mu) / len(mu)) ** 0.5), max(map(abs, mu))
        turns = sum((p < 0) != (q < 0) for p, q in zip(mu, mu[1:], strict=False))
        assert r.feature == ":".join(f"{c:08x}" for c in crcs) + f":{root}:{peak}:{turns}"


def test_coded_pcm_is_lossless():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 100, 1001):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        rate, back = audio.uncoded(audio.coded(x, 16000))
        assert rate == 16000 and back.tolist() == x.tolist()
    with pytest.raises(ValueError):
        audio.uncoded(b"junk")


def test_partial_blocks_and_other_depths():
    raw = bytes(range(100))
    found = audio.samples_of(audio.wave(raw, audio.IMA_ADPCM, 8000, 64, 4, 121))[1].tolist()
    assert found == plain_adpcm(raw[:64]) + plain_adpcm(raw[64:])
    assert audio.samples_of(audio.wave(b"\0\x80\xff", audio.PCM, 8000, 1, 8))[1].tolist() == [-32768, 0, 32512]
    with pytest.raises(ValueError):
        audio.samples_of(audio.wave(raw, audio.PCM, 8000, 3, 24))
    stereo = bytearray(audio.wave(raw, audio.PCM, 8000, 2, 16))
    stereo[22] = 2
    with pytest.raises(ValueError):
        audio.samples_of(bytes(stereo))


def test_outputs_take_empty_tables_null_ids_and_repeats(spark, corpus):
    extra = [(None, "no id", None, None, None), (None, None, None, None, None), (2, "twice", "en", "x", 1), (2, "twice", "en", "x", 1)]
    for query in (token_orc.op1_token_orc, sharding.op2_sharding, audio.op9_audio, packing.op10_best_two_fit):
        assert query(spark, corpus([])).count() == 0
        ids = sorted(str(r.doc_id) for r in query(spark, corpus(["a", "b", "c"], extra=extra)).collect())
        assert ids == sorted(["0", "1", "2", "2", "2", "None", "None"]), query.__name__


def test_pcm_column(spark):
    raw = bytes(range(256))
    media = [(1, audio.wave(raw)), (2, audio.wave(raw, audio.A_LAW)), (3, audio.wave(raw, audio.IMA_ADPCM, 8000, 64, 4, 121)), (4, b"junk"), (5, None)]
    rows = {r.doc_id: r.pcm for r in audio.pcm_column(spark.createDataFrame(media, "doc_id long, media binary")).collect()}
    assert rows[4] is None and rows[5] is None
    assert audio.samples_of(bytes(rows[1]))[1].tolist() == audio.resample(audio.MU_TABLE[np.frombuffer(raw, dtype=np.uint8)], 8000, 16000).tolist()
    assert len(audio.samples_of(bytes(rows[3]))[1]) == 2 * 4 * 121


def test_op10(spark, corpus):
    texts = [*ODD, *(sentence(i, n) for i, n in enumerate(range(5, 900, 30)))]
    rows = packing.op10_best_two_fit(spark, corpus(texts)).collect()
    plain, want = library("word_bpe_49k.json"), {}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p in range(-(-len(ids) // 2048)):
            part = ids[2048 * p : 2048 * (p + 1)]
            want[i, p] = (2048 * p, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1
    assert packing.op10_best_two_fit(spark, corpus([])).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(50):
        counts = {rng.randint(1, 60): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        used: dict = {}
        for lengths, times in packing.plan(counts, 64):
            assert sum(lengths) <= 64
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts


def test_two_pieces_replace_the_smallest():
    # 60 + 30 leaves 10; without the 30 the gap is 40, which 25 + 14 fill to 39
    assert packing.plan({60: 1, 30: 1, 25: 1, 14: 1}, 100)[0] == ([60, 25, 14], 1)


def plain_plan(lengths, most):
    """Best-two-fit on a list of lengths: every pair is tried; a pattern is repeated while its pieces last."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        taken, room = [], most
        while fits := [n for n in left if n <= room]:
            taken.append(fits[0])
            left.remove(fits[0])
            room -= fits[0]
        if room and len(taken) > 1:
            gap, least = room + taken[-1], taken[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap]
            if pairs:
                _, a, b = max(pairs)
                left.append(taken.pop())
                for n in (a, b):
                    left.remove(n)
                    taken.append(n)
                left.sort(reverse=True)
        out.append(sorted(taken))
        while all(left.count(n) >= taken.count(n) for n in taken):
            for n in taken:
                left.remove(n)
            out.append(sorted(taken))
    return sorted(out)


def test_plans_are_best_two_fit():
    rng = random.Random(12)
    for most in (20, 64, 101):
        for _ in range(60):
            lengths = [rng.choice([rng.randint(1, most), rng.randint(most // 4, most // 2), 7]) for _ in range(rng.randint(0, 40))]
            counts = {n: lengths.count(n) for n in lengths}
            got = sorted(sorted(pattern) for pattern, times in packing.plan(counts, most) for _ in range(times))
            assert got == plain_plan(lengths, most)
