"""The partitioned vector index: recall, exactness, pruning, tiles, odd vectors."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import passages, retrieval
from attestor.sources import vectors as V
from attestor.sources.store import ChunkStore

DATA = Path("/root/testdata/sf0.1")


def clustered(spark, n=1200, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")


def best(rows, k):
    """The k nearest of each query by plain numpy, equal scores with the lower id first."""
    ids = [r.vec_id for r in rows]
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(x @ x.T, 6)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:k]] for i in range(0, len(ids), 20)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_all_lists_are_exact_and_the_calibrated_ones_nearly(spark, tmp_path, monkeypatch):
    rows = clustered(spark)
    want = best(rows.collect(), 5)
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    centroids, probes = index.centroids()
    assert 1 <= probes < len(centroids) // 2
    assert found(index.search(asked, 5, V.MOST_LISTS)) == want
    monkeypatch.setattr(V, "TILE_VECTORS", 20)
    monkeypatch.setattr(V, "TILE_QUERIES", 3)
    assert found(index.search(asked, 5, V.MOST_LISTS)) == want
    got = found(index.search(asked, 5))
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_only_probed_partitions_are_read(spark, tmp_path):
    rows = clustered(spark, 300)
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows, n_lists=10)
    asked = rows.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = index.search(asked, 3, 1)
    assert re.search(r"PartitionFilters: \[[^\]]*\(?list#", plan._jdf.queryExecution().executedPlan().toString())
    assert found(plan)[7][0] == 7


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, []), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [0.0, 2.0]), (7, [3.0, 0.0]), (8, [3.0, 0.0])], "vec_id long, embedding array<float>")
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows)
    assert sorted(r.vec_id for r in index.lists().collect()) == [1, 6, 7, 8]
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 0.0, 0.0])], "query_id string, q array<float>")
    assert found(index.search(asked, 2, 9)) == {"a": [1, 7]}
    empty = V.VectorIndex(spark, str(tmp_path / "e"))
    empty.build(rows.where("vec_id = 2"))
    assert empty.search(asked, 2).count() == 0
    with pytest.raises(ValueError, match="from 1 to 2"):
        V.VectorIndex(spark, str(tmp_path / "w")).build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_recall_on_the_tables(spark, tmp_path):
    rows = spark.read.parquet(str(DATA / "embeddings.parquet"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows)
    want, got = best(rows.orderBy("vec_id").collect(), 8), found(index.search(asked, 8))
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * 8 * len(want)


def test_the_store_searches_its_index(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    chunks = clustered(spark, 200).select(F.lit("d").alias("doc_id"), F.col("vec_id").cast("int").alias("idx"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), F.lit("p").alias("parent"), F.concat(F.lit("d_"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    store.upsert(chunks)
    asked = chunks.where("idx = 9").first().embedding
    assert store.search(asked, 5, exact=False).collect() == store.search(asked, 5).collect()  # no index yet
    store.build_vectors(n_lists=8)
    near = store.search(asked, 5, exact=False, probes=8)
    assert near.collect() == store.search(asked, 5).collect() and near.first().idx == 9
    store.delete(spark.createDataFrame([("d",)], ["doc_id"]))
    assert store.search(asked, 5, exact=False).count() == 0


def letters(seen=None):
    """A toy model's loader; each text that it gets is noted in the folder `seen`."""

    def load():
        import os
        import uuid

        def embed(texts):
            assert len(texts) <= 50
            if seen:
                for t in texts:
                    with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                        f.write(t)
            return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

        return embed

    return load


def test_stored_embeddings_are_read_by_the_provider(spark, tmp_path):
    docs = spark.createDataFrame([("a", "The tower is tall and old. It was built by an engineer in Paris. Many people visit it every year.")], ["doc_id", "text"])
    claims = spark.createDataFrame([("r", 0, "a", "an engineer built it in paris")], "response_id string, claim_no int, doc_id string, claim string")
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(retrieval.embedded(passages.chunks(docs), "text", letters()))
    by_store = retrieval.hybrid(claims, store.index(claims), 2, retrieval.stored_cosine(letters())).collect()
    by_model = retrieval.hybrid(claims, passages.chunk_lists(docs), 2, retrieval.model_cosine(letters())).collect()
    assert by_store == by_model and len(by_store) == 2


def test_a_text_meets_the_model_once(spark, tmp_path):
    from attestor.sources.cache import ContentCache

    seen = tmp_path / "seen"
    seen.mkdir()
    cache = lambda: ContentCache(spark, str(tmp_path / "cache"), "embedding array<float>")
    asked = lambda: sorted(p.read_text() for p in seen.iterdir())
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "id long, text string")
    rows = retrieval.embedded_once(first, "text", letters(str(seen)), cache()).collect()
    assert asked() == ["one", "two"] and {r.id: r.embedding is None for r in rows} == {1: False, 2: False, 3: False, 4: True}
    more = spark.createDataFrame([(5, "two"), (6, "three")], "id long, text string")
    again = retrieval.embedded_once(more, "text", letters(str(seen)), cache()).collect()
    assert asked() == ["one", "three", "two"] and [r.embedding for r in again if r.id == 5] == [r.embedding for r in rows if r.id == 2]
    assert cache().read().count() == 3
    assert retrieval.embedded_once(first.limit(0), "text", letters(str(seen)), cache()).count() == 0


def test_the_judge_is_asked_again_after_errors_and_never_after_replies(spark, tmp_path):
    from attestor.operators import models

    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    def call(prompt):
        import os
        import uuid

        kind = "bad" if "always bad" in prompt else "flaky" if "flaky" in prompt else "good"
        before = sum(n.startswith(kind) for n in os.listdir(folder))
        open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w").close()
        if kind == "bad" or kind == "flaky" and not before:
            raise OSError("too many requests")
        return "REASONING: r\nVERDICT: SUPPORTED\nCONFIDENCE: HIGH\nCORRECTION: N/A"

    gated = spark.createDataFrame([("r", "d", i, c, ["p"]) for i, c in enumerate(["good one", "flaky one", "always bad", "good one"])], "response_id string, doc_id string, claim_no int, claim string, parents array<string>")
    judge = models.Judge(call, calls=2, replies=str(tmp_path / "replies"), tries=2, wait=0.01)
    count = lambda: {k: sum(p.name.startswith(k) for p in seen.iterdir()) for k in ("good", "flaky", "bad")}
    verdicts = lambda: {r.claim_no: (r.llm_verdict, r.reasoning) for r in models.judged(gated, judge).collect()}
    fine = ("SUPPORTED", "r")
    want = {0: fine, 1: fine, 2: ("UNKNOWN", "API error: too many requests"), 3: fine}
    assert verdicts() == want and count() == {"good": 1, "flaky": 2, "bad": 2}
    assert verdicts() == want and count() == {"good": 1, "flaky": 2, "bad": 4}


def test_a_stored_verification_embeds_each_text_once(spark, tmp_path):
    from attestor.plans.verify import verify_stored

    seen = tmp_path / "seen"
    seen.mkdir()
    embedder = retrieval.Embedder(letters(str(seen)), str(tmp_path / "cache"))
    docs = spark.createDataFrame([("a", "The tower is tall and old. It was built by an engineer in Paris. Many people visit it every year.")], ["doc_id", "text"])
    said = spark.createDataFrame([("r", "a", "The tower in the city was built by an engineer in Paris."), ("s", "a", "The tower in the city was built by an engineer in Paris.")], ["response_id", "doc_id", "text"])
    store = ChunkStore(spark, str(tmp_path / "s"))
    first = sorted(map(str, verify_stored(store, docs, said, embedder=embedder).collect()))
    asked = sorted(p.read_text() for p in seen.iterdir())
    assert len(asked) == len(set(asked)) == 4 and store.read().where("embedding is null").count() == 0
    assert sorted(map(str, verify_stored(store, docs, said, embedder=embedder).collect())) == first
    other = ChunkStore(spark, str(tmp_path / "other"))
    verify_stored(other, docs, said, embedder=embedder).collect()
    assert len(list(seen.iterdir())) == 4


def test_the_package_is_sent(tmp_path):
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from attestor.ship import ship
ship(spark)
from attestor.sources.vectors import matrix
def ask(batches):
    from attestor.sources import vectors
    for b in batches:
        yield b
assert spark.range(3).mapInArrow(ask, "id long").count() == 3
print("sent")
"""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert "sent" in done.stdout, done.stderr[-2000:]
