"""The prefix trie, importance resampling and context-tree weighting against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from corpus_cases import ODD, sentence
from pyspark.sql import functions as F

from attestor.llm import context_tree, importance, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
DATA = Path("/root/testdata/sf0.01")


def plain_trie(conversations):
    """(member ids of each node, by its prefix) of {id: [(role, text), ...]}, and the rows that the trie must have."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(p))
        rows.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def in_order(rows):
    """{id: turns} of rows as the operator orders them."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "é中", "long " * 40])) for c in [*range(0, 12), *range(96, 112), 205, 207, -3, -105] for t in range(rng.randint(1, 8))]
    rows += [(7, None, None, None), (7, None, "u", "b"), (7, None, "a", "z"), (7, 1, "u", "x"), (7, 1, "u", "x"), (None, 0, "u", "x"), (1 << 40, 0, "u", "x")]
    rows += [(c, t, "u", "same") for c in range(300, 330) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_trie(spark, turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 3)
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    got = prefix_trie.trie(prefix_trie.numbered(df)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(in_order(turns))
    assert prefix_trie.trie(prefix_trie.numbered(df.where("false"))).count() == 0


def test_op11(spark, turns, tmp_path):
    df = spark.createDataFrame(turns, TURNS).withColumns({"depth": F.lit(9), "place": F.lit(9), "digest": F.lit("x"), "run": F.lit(1)})
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    whole = in_order(turns)
    new = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = [*whole.get(c - int(math.fmod(c, 100)), [])[:h], *own[h:]]
    assert any(not t for t in new.values())
    assert sorted(map(tuple, prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()), key=str) == plain_trie(new)


def test_ends_in_runs(spark):
    ids = random.Random(1).sample(range(-500, 500), 300)
    paths = spark.createDataFrame([(c, b"n%d" % (c % 3), True) for c in ids], "conv_id long, digest binary, last boolean")
    got = {bytes(r.digest): r.ends_sha256 for r in prefix_trie.ends(paths, run_ids=7).collect()}
    assert got == {b"n%d" % k: hashlib.sha256(",".join(str(c) for c in sorted(ids) if c % 3 == k).encode()).hexdigest() for k in range(3)}


def test_a_long_conversation_sends_a_row_a_turn(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("ab").alias("text"))
    more = spark.createDataFrame([(2, t, "u", "ab") for t in range(2999)], TURNS)
    rows = {r.depth: r for r in prefix_trie.trie(prefix_trie.numbered(df.union(more))).collect()}
    assert len(rows) == 3001 and rows[0].saved_tokens == 2 * 2999 and rows[2999].saved_tokens == 2 and rows[3000].saved_tokens == 0
    assert {r.n_leaves for r in rows.values()} == {1}


_SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_importance(docs, target, longest, n_buckets, seed, percent, least):
    def features(text):
        w = _SPLIT.findall((text or "").translate(_LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + n_buckets) / ((s[b] + 1) * (n_t + n_buckets))))
    rows = []
    for (i, _), (n_words, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "n_buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 1 << 12, 100)])
def test_importance(spark, longest, n_buckets, percent):
    docs = [*enumerate(ODD), *((100 + i, sentence(i, 3 * i)) for i in range(20)), (5, "again " * 30), (5, "again " * 30), (None, sentence(3, 50))]
    target = [None, "", "A a9z b.", sentence(2), sentence(4, 12)]
    columns = {c: F.lit(1) for c in ("row", "bucket", "score", "rank", "words")}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(columns).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(df, wanted, longest, n_buckets, 7, percent, 5)
    assert sorted(map(tuple, got.collect()), key=str) == plain_importance(docs, target, longest, n_buckets, 7, percent, 5)


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resampled(none, one).count() == 0
    assert sorted((r.doc_id, r.n_features, r.rank) for r in importance.resampled(one, none, least_words=1, percent=100).collect()) == [(1, 2, 1), (2, 0, None)]
    with pytest.raises(ValueError, match="n_buckets"):
        importance.resampled(one, one, n_buckets=0)


def test_op12_stays_in_the_jvm(spark, corpus):
    plan = importance.op12_importance(spark, corpus(ODD, benchmark=[(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def positions(text):
    full = text + b"\xff"
    before = b"\0" * context_tree.DEPTH + full
    for i, b in enumerate(full):
        for k in range(8):
            yield before[i : i + context_tree.DEPTH][::-1], (k, b >> (8 - k)), b >> (7 - k) & 1


def plain_scores(rows):
    """held_out, tokens, known tokens, training tokens, base score and score of (held_out, text) rows, node by node."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = [(h, (t or "").encode().translate(low)) for h, t in rows]
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", t), None] for _, t in texts]
    count = Counter(w for (h, _), ws in zip(texts, words, strict=True) if not h for w in ws)
    total, distinct, depth = sum(count.values()), len(count), context_tree.DEPTH
    nodes = {}
    for h, t in texts:
        if not h:
            for context, node, bit in positions(t):
                for d in range(depth + 1):
                    nodes.setdefault((context[:d], node), [0, 0])[bit] += 1
    below, weighted, share = Counter(), {}, {}
    for context, node in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[context, node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        split, most = below[context, node], max(own, below[context, node])
        both = most + math.log(math.exp(own - most) + math.exp(split - most))
        share[context, node] = math.exp(own - both)
        weighted[context, node] = own if len(context) == depth else both - math.log(2)
        if context:
            below[context[:-1], node] += weighted[context, node]
    out = []
    for (h, t), ws in zip(texts, words, strict=True):
        score = 0.0
        for context, node, bit in positions(t):
            p = None
            for d in range(depth, -1, -1):
                if n := nodes.get((context[:d], node)):
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    p = own if p is None else share[context[:d], node] * own + (1 - share[context[:d], node]) * p
            score += math.log10(0.5 if p is None else p)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        out.append((h, len(ws), sum(count[w] > 0 for w in ws), total, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9)))
    return out


@pytest.mark.parametrize("block_bytes", [context_tree.BLOCK_BYTES, 300])
@pytest.mark.parametrize("trained", [True, False])
def test_context_tree(spark, monkeypatch, block_bytes, trained):
    for name, value in {"WINDOW": 64, "KEYS_A_ROW": 50, "LOOSE": 100, "TASK_GRAMS": 500}.items():
        monkeypatch.setattr(context_tree, name, value)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé AZ", k=rng.randint(1, 6))) for _ in range(30)]
    texts = [*(t if t is None else t[:800] for t in ODD), *(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(30)), "\0\0a", "QQ \n 中文"]
    rows = [(i, i % 4 == 1 or not trained, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").withColumns({c: F.lit(1) for c in ("block", "kind", "key", "keys", "n")})
    got = {r.doc_id: r for r in context_tree.scores(df.repartition(3), block_bytes).collect()}
    assert len(got) == len(rows)
    for (i, *_), want in zip(rows, plain_scores([r[1:] for r in rows]), strict=True):
        assert tuple(got[i][1:7]) == want
        assert got[i].bits_per_byte == pytest.approx(-got[i].score * math.log2(10) / (len((texts[i] or "").encode()) + 1))


def test_context_tree_takes_odd_rows(spark):
    rows = [(None, None, "a b"), (3, False, "x y"), (3, False, "x y"), (3, True, None)]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in context_tree.scores(df).collect()), key=str)
    assert got == sorted([(None, False, 3, 9), (3, False, 3, 9), (3, False, 3, 9), (3, True, 1, 9)], key=str)
    assert context_tree.scores(df.where("false")).count() == 0


def test_log_gamma():
    import numpy as np

    x = np.concatenate([np.arange(0.5, 60, 0.5), 10.0 ** np.arange(2, 13)])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x.tolist()], rel=1e-11, abs=1e-11)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from attestor.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    frame = QUERIES[name](spark, str(DATA)).toPandas()
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values.tolist()), key=str)
    assert rows(frame) == rows(con.execute(SQL[name]).df())


def test_op13_learns_from_the_rows_that_are_not_held_out(spark, corpus):
    texts = [sentence(i % 7, 40) for i in range(60)]
    rows = context_tree.op13_context_tree(spark, corpus(texts)).collect()
    want = plain_scores([(zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in enumerate(texts)])
    assert [tuple(r[1:7]) for r in sorted(rows, key=lambda r: r.doc_id)] == want
