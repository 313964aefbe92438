"""Values derived by hand."""

from __future__ import annotations

import math
import random
import re
import zlib
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestor.functions import facts as K
from attestor.functions import text as T
from attestor.operators import models, passages, retrieval, summary
from attestor.operators.verdict import needs_judge, verdict
from attestor.plans.catalogue import QUERIES
from attestor.plans.verify import Options, Providers, verify
from attestor.sources.inputs import pair
from attestor.sources.store import ChunkStore

TOWER = """
    The Eiffel Tower is located in Paris, France. It was built in 1889
    by Gustave Eiffel. The tower stands 330 meters tall. It was originally
    built as the entrance arch for the 1889 World Fair. More than 7 million
    people visit it every year. The tower has three floors for visitors.
    On the top floor there is a restaurant and a small apartment where
    Gustave Eiffel used to receive guests.
"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("out")).first().out


def test_chunks_of_a_paragraph(spark):
    docs = spark.createDataFrame([(1, TOWER), (2, ""), (3, None)], "doc_id int, text string")
    rows = passages.chunks(docs).orderBy("idx").collect()
    found = [r.sentence for r in passages.sentences(docs).orderBy("pos").collect()]
    assert len(found) == 7 and [r.idx for r in rows] == list(range(7))
    assert rows[0].text == f"{found[0]} {found[1]}" and rows[4].text == found[4] == "More than 7 million people visit it every year."
    assert rows[5].text == rows[5].parent == f"{found[5]} {found[6]}" and rows[6].text == found[6]


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t"), 1), t="Alpha one. Beta two! gamma. Delta") == ["Alpha one.", "Beta two! gamma.", "Delta"]
    assert one(spark, T.sentences(F.col("t")), t="123456789012345") == []
    assert one(spark, T.sentences(F.col("t")), t="1234567890123456") == ["1234567890123456"]


def test_claims(spark):
    say = lambda n, c="w": (" ".join([c * 3] * n)).capitalize() + "."
    text = " ".join([say(8), say(9), say(59), say(60), say(9)])
    assert one(spark, T.claims(F.col("t")), t=text) == [say(9), say(59)]
    many = " ".join(say(9, chr(97 + i)) for i in range(21))
    assert one(spark, T.claims(F.col("t")), t=many) == [say(9, chr(97 + i)) for i in range(20)]


def test_page_lines(spark):
    text = "\n".join(["  Title  ", "12", "2024", "", "ab", "abc", "\t\xa0 12a\xa0"])
    assert one(spark, T.page_lines(F.col("t")), t=text) == ["Title", "abc", "12a"]


@pytest.mark.parametrize(
    ("source", "claim", "points"),
    [
        ("In 2019 the World Health Organization said 40% of patients in 12 countries recovered.", "In 1999 the World Trade Organization confirmed that 75% of patients in 30 countries always recovered.", 100),
        ("In 2019 the World Health Organization said 40% of patients in 12 countries recovered.", "In 2001 the World Health Organization said 40% of patients in 12 countries recovered.", 0),
        ("The program helped patients in many places.", "The program helped 50% of patients.", 30),
        ("It ran in 1,000 countries.", "It ran in 5,000 countries.", 0),
    ],
)
def test_fact_points(spark, source, claim, points):
    df = spark.createDataFrame([(source, claim)], ["s", "c"]).select("*", K.facts(F.col("c")).alias("cf"), K.facts(F.col("s")).alias("sf"))
    got = df.select(K.compared(F.col("cf"), F.col("sf"), F.col("s")).alias("x")).first().x
    assert got.points == points and got.contradicts == (points >= 30)


def test_full_years(spark):
    assert one(spark, K.years(F.col("t")), t="1889 and 2001 and 1999") == ["19", "20"]
    assert one(spark, K.years(F.col("t"), True), t="1989 and 2001") == ["1989", "2001"]


@pytest.mark.parametrize(("hits", "rank"), [([("ENTAILMENT", 0.99), ("contradiction", 0.7)], 1), ([("ENTAILMENT", 0.6), ("CONTRADICTION", 0.7)], 2), ([("NEUTRAL", 0.6), ("ENTAILMENT", 0.99)], 1), ([("CONTRADICTION", 0.5), ("CONTRADICTION", 0.9), ("CONTRADICTION", 0.9)], 2)])
def test_best_evidence(spark, hits, rank):
    rows = [("r", 1, 0, "c", i + 1, f"p{i + 1}", label, score) for i, (label, score) in enumerate(hits)]
    df = spark.createDataFrame(rows, "response_id string, doc_id int, claim_no int, claim string, rank int, parent string, label string, nli_score double")
    assert models.best_evidence(df).first().evidence == f"p{rank}"


def expected_case(label, s, f, llm):
    """The fusion written plainly, with doubles."""
    c, h = label == "CONTRADICTION", llm == "HALLUCINATED"
    if f >= 0.5:
        x = min(0.5 * f + 0.3 * c + 0.2 * h, 1.0)
        if x >= 0.4:
            return 1, "Hallucinated", round(x, 2), "HIGH" if x >= 0.6 else "MEDIUM"
    if label == "ENTAILMENT" and s >= 0.85 and f < 0.2:
        return 2, "Supported", 0.0, "HIGH"
    if c and s >= 0.85:
        return 3, "Hallucinated", round(min(0.6 + 0.2 * f + 0.2 * h, 1.0), 2), "HIGH"
    if llm != "none":
        x = round(0.4 * c + 0.35 * h + 0.25 * f, 2)
        return 4, "Hallucinated" if x >= 0.6 else "Uncertain" if x >= 0.3 else "Supported", x, "LOW"
    return 5, "Uncertain", round(0.3 + 0.2 * f, 2), "LOW"


def test_fusion_on_the_whole_grid(spark):
    grid = [(lab, s, p * 5, llm) for lab, s, p, llm in product(("ENTAILMENT", "CONTRADICTION", "NEUTRAL"), (0.5, 0.84, 0.85, 0.92), range(21), ("none", "HALLUCINATED", "SUPPORTED", "UNKNOWN"))]
    df = spark.createDataFrame(grid, ["label", "s", "points", "llm"]).coalesce(1)
    signals = F.array().cast("array<string>")
    v = verdict(F.col("label"), F.col("s"), F.lit("e"), F.col("points").cast("int"), signals, F.col("llm") != "none", F.col("llm"), F.lit("r"), F.lit("LOW"), F.lit("x"))
    for row in df.withColumn("v", v).withColumn("ask", needs_judge(F.col("label"), F.col("s"), F.col("points"))).collect():
        f = row.points / 100
        assert (row.v.case, row.v.verdict, row.v.hallucination_score, row.v.confidence) == expected_case(row.label, row.s, f, row.llm)
        skip = (row.label == "ENTAILMENT" and row.s >= 0.85 and f < 0.2) or (row.label == "CONTRADICTION" and row.s >= 0.92)
        assert row.ask == (f >= 0.4 or not skip)


@pytest.mark.parametrize(("n", "sections"), [(0, 0), (1, 1), (3, 3), (9, 9), (10, 5), (14, 7), (19, 7), (20, 5)])
def test_sections(spark, n, sections):
    df = spark.createDataFrame([("r", i, "Hallucinated") for i in range(n)], "response_id string, claim_no int, verdict string")
    rows = summary.densities(df).collect()
    assert len(rows) == sections and sum(r.claims for r in rows) == n


def test_autocorrect_replaces_every_occurrence(spark):
    said = spark.createDataFrame([("r", "abcb"), ("s", "b")], ["response_id", "text"])
    rows = spark.createDataFrame([("r", 0, "b", "X", "Hallucinated")], ["response_id", "claim_no", "claim", "correction", "verdict"])
    got = {r.response_id: r.corrected for r in summary.corrected(said, rows).collect()}
    assert got == {"r": "a**[CORRECTED: X]**c**[CORRECTED: X]**", "s": "b"}


def test_a_failing_judge_is_unknown(spark):
    def call(prompt: str) -> str:
        raise RuntimeError("no service")

    docs, said = pair(spark, TOWER, "Napoleon Bonaparte designed the tall iron tower that stands near the river in Berlin.")
    row = verify(docs, said, Providers(judge=models.Judge(call, 1)), Options(top_k=2)).first()
    assert row.needs_judge and row.llm_used and row.verdict in ("Supported", "Uncertain") and "API error: no service" in row.reasoning


def test_missing_documents_and_claims(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    said = spark.createDataFrame([("a", 1, "This is one claim that has nine words here."), ("b", 2, "Short one."), ("c", 1, None)], "response_id string, doc_id long, text string")
    rows = verify(docs, said).collect()
    assert [(r.response_id, r.verdict, r.needs_judge) for r in rows] == [("a", "Uncertain", False)]
    counts = {r.response_id: (r.total_claims, r.hallucination_rate) for r in summary.summaries(verify(docs, said), said).collect()}
    assert counts == {"a": (1, 0.0), "b": (0, 0.0), "c": (0, 0.0)}


def test_pair_needs_both_texts(spark):
    with pytest.raises(ValueError):
        pair(spark, "", "x")


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", TOWER), ("b", TOWER + " One more sentence is here now.")], ["doc_id", "text"])
    assert store.count() == 0
    store.upsert(passages.chunks(docs))
    assert store.count() == 15 and store.of_document("b").count() == 8
    store.upsert(passages.chunks(spark.createDataFrame([("b", "Only this sentence is left of it.")], ["doc_id", "text"])))
    store.upsert(passages.chunks(docs.limit(0)))
    assert (store.of_document("a").count(), store.of_document("b").count()) == (7, 1)
    assert store.missing(docs).count() == 0
    store.delete(spark.createDataFrame([("a",)], ["doc_id"]))
    assert [r.doc_id for r in store.documents().collect()] == ["b"] and store.of_document("a").count() == 0
    store.delete(spark.createDataFrame([("b",), ("none",)], ["doc_id"]))
    assert store.count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["store"]  # nothing staged is left


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.upsert(passages.chunks(spark.createDataFrame([("a", TOWER), ("b", TOWER)], ["doc_id", "text"])))
    before = sorted(map(str, store.read().collect()))
    broken = spark.createDataFrame([("a",), ("b",)], ["doc_id"]).select(F.when(F.col("doc_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id")).alias("doc_id"))
    with pytest.raises(Exception, match="lost"):
        store.delete(broken)
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken.select("doc_id", F.lit(0).alias("idx"), F.lit("t").alias("text"), F.lit("p").alias("parent"), F.lit("c").alias("chunk_id")))
    assert sorted(map(str, store.read().collect())) == before and [p.name for p in tmp_path.iterdir()] == ["store"]
    assert store.table.versions() == [1] and not store.table.vacuum()  # no folder of the failed writes is left


def live(store):
    return {n: sorted(map(str, store.table.read(n).drop("entries").collect())) for n in store.table.parts}


def test_a_write_of_one_document_appends_that_document_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(f"d{i}", TOWER + f" Sentence number {i} is the last one here.") for i in range(30)], ["doc_id", "text"])
    store.upsert(passages.chunks(docs))
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    store.upsert(passages.chunks(docs.where("doc_id = 'd7'").withColumn("text", F.lit("Only this sentence is left of it."))))
    now = set((tmp_path / "store" / "data").rglob("*.parquet"))
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    folders = {p.parent for p in now - set(kept)}
    assert len(folders) == 4 and spark.read.parquet(*map(str, folders)).where("doc_id <> 'd7'").count() == 0
    assert store.of_document("d7").count() == 1 and store.count() == store.read().count() == 29 * 8 + 1
    # old versions stay as they were, until they are vacuumed
    assert store.read(version=1).count() == 30 * 8
    with pytest.raises(ValueError, match="no version"):
        store.read(version=9)
    rebuilt = ChunkStore(spark, str(tmp_path / "rebuilt"))
    rebuilt.upsert(store.read())
    before = live(store)
    assert before == live(rebuilt)
    store.table.compact()
    assert live(store) == before and len(store.table.commits()) == 1
    assert store.table.vacuum() and live(store) == before and store.table.versions() == [3]


def test_writers_that_meet_both_commit(spark, tmp_path, monkeypatch):
    from attestor.sources.snapshots import SnapshotTable

    one, two = (SnapshotTable(spark, str(tmp_path / "t"), {"rows": "doc_id string, n int"}) for _ in range(2))
    one.commit({"rows": spark.createDataFrame([("a", 1)], ["doc_id", "n"])})
    seen = one.versions()
    two.commit({"rows": spark.createDataFrame([("b", 2)], ["doc_id", "n"])})
    real, calls = one.versions, []
    monkeypatch.setattr(one, "versions", lambda: calls.append(1) or (seen if len(calls) < 3 else real()))
    assert one.commit({"rows": spark.createDataFrame([("a", 3)], ["doc_id", "n"])}, spark.createDataFrame([("a",)], ["doc_id"])) == 3
    assert sorted(map(tuple, two.read("rows").collect())) == [("a", 3), ("b", 2)]


def test_block_max_skipping_finds_the_best_chunks(spark):
    import random

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "rare", "the", "of", "and"]
    text = " ".join(" ".join(rng.choices(words, weights=[2, 2, 2, 2, 1, 9, 9, 9], k=rng.randint(4, 9))).capitalize() + "." for _ in range(400))
    docs = spark.createDataFrame([("d", text), ("e", "Alpha beta gamma delta."), ("f", "The of and the of. The of and the of.")], ["doc_id", "text"])
    claims = spark.createDataFrame([("r", i, d, c) for i, (d, c) in enumerate([("d", "alpha rare"), ("d", "the of and"), ("d", "Rare rare beta delta."), ("e", "gamma"), ("f", "the of"), ("d", "unknown")])], "response_id string, claim_no int, doc_id string, claim string")
    lists = passages.chunk_lists(docs)
    index = retrieval.Index.of(lists, block=4)
    assert index.blocks.where("doc_id = 'd'").select("block").distinct().count() > 50
    every = {}
    for r in retrieval.shared_scores(claims, retrieval.Index.of(lists)).collect():
        every.setdefault(r.claim_no, []).append((-round(r.bm25, 9), r.idx))
    for k, first in ((3, 1), (10, 2)):
        got = {}
        for r in retrieval.bm25_topk(claims, index, k, first).collect():
            got.setdefault(r.claim_no, {})[r["rank"]] = (-r.bm25, r.idx)
        assert {c: [x[i] for i in sorted(x)] for c, x in got.items()} == {c: sorted(x)[:k] for c, x in every.items()}


def test_store_search(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = [("a", 0, "x", "p", "a_0", [1.0, 0.0]), ("a", 1, "y", "p", "a_1", [0.6, 0.8]), ("b", 0, "z", "q", "b_0", [1.0, 0.0]), ("b", 1, "none", "q", "b_1", None)]
    store.upsert(spark.createDataFrame(rows, "doc_id string, idx int, text string, parent string, chunk_id string, embedding array<float>"))
    assert [(r.text, r.score) for r in store.search([2.0, 0.0], 3).collect()] == [("x", 1.0), ("z", 1.0), ("y", 0.6)]
    assert [r.text for r in store.search([0.0, 1.0], 4, "b").collect()] == ["z"]


def test_stored_documents_are_not_split_again(spark, tmp_path):
    from attestor.plans.verify import verify_stored

    store = ChunkStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", TOWER)], ["doc_id", "text"])
    said = spark.createDataFrame([("r", "a", "The tower stands 330 meters tall and was built by Gustave Eiffel in Paris.")], ["response_id", "doc_id", "text"])
    first = verify_stored(store, docs, said).collect()
    assert first == verify(docs, said).collect() and store.count() == 7
    other = spark.createDataFrame([("a", "Another text under the same name is not read.")], ["doc_id", "text"])
    assert verify_stored(store, other, said).collect() == first and store.count() == 7


def test_limits_can_be_lifted(spark):
    text = " ".join(f"Claim number {'x' * (i + 1)} has quite a few words in it." for i in range(25))
    docs, said = pair(spark, TOWER, text)
    assert verify(docs, said).count() == 20
    assert verify(docs, said, options=Options(claim_limit=None)).count() == 25
    names = " and ".join(f"Big Bank {chr(65 + i % 26)}{'x' * (i // 26 + 1)}" for i in range(30))
    assert len(one(spark, K.organizations(F.col("t")), t=names)) == 20 and len(one(spark, K.organizations(F.col("t"), most=None), t=names)) == 30


def test_a_judge_is_asked_once_for_a_prompt(spark, tmp_path):
    log = str(tmp_path / "asked")

    def call(prompt: str) -> str:
        with open(log, "a") as f:
            f.write("x\n")
        return "VERDICT: SUPPORTED"

    docs, said = pair(spark, TOWER, "Napoleon Bonaparte designed the tall iron tower that stands near the river in Berlin.")
    said = said.union(said.withColumn("response_id", F.lit("1")))
    rows = verify(docs, said, Providers(judge=models.Judge(call, 1)), Options(top_k=2))
    assert rows.count() == 2 and all(r.llm_used for r in rows.collect())
    assert open(log).read().count("x") == 1


def test_vector_search_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(1)
    x[7] = 0
    rows = [(i, [float(v) for v in x[i]] if i != 9 else None, i % 3) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    for same in (False, True):
        got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 5)) for r in retrieval.vector_topk(asked, vectors, 4, same, block=4).collect()}
        for q in range(0, 300, 20):
            live = [i for i in range(300) if i not in (7, 9) and (not same or i % 3 == q % 3)]
            best = sorted(live, key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:4]
            assert [got[q, r + 1][0] for r in range(4)] == best


def test_correction_across_line_breaks(spark):
    said = spark.createDataFrame([("r", "It says\nthis thing.")], ["response_id", "text"])
    rows = spark.createDataFrame([("r", 0, "It says this thing.", "X", "Hallucinated")], ["response_id", "claim_no", "claim", "correction", "verdict"])
    assert summary.corrected(said, rows).first().corrected == "It says\nthis thing."
    assert summary.corrected(said, rows, normalise=True).first().corrected == "**[CORRECTED: X]**"


def test_default_scores_equal_a_provider_of_the_same(spark):
    """Fusion within the row, and over all chunks as a provider's scores take it."""
    lists = passages.chunk_lists(spark.createDataFrame([(1, TOWER + " " + TOWER), (2, "One sentence is here alone.")], "doc_id long, text string"))
    claims = spark.createDataFrame([("r", 1, 0, "When was the tower built for the fair and by whom?"), ("r", 1, 1, "nothing shared xyz"), ("s", 2, 0, "one sentence is here")], "response_id string, doc_id long, claim_no int, claim string")
    same = lambda claims, chunks: retrieval.shared_scores(claims, lists).drop("bm25")
    a, b = (sorted(map(str, retrieval.hybrid(claims, lists, 3, given).collect())) for given in (None, same))
    assert a == b and len(a) > 3


def test_stream(spark, tmp_path):
    from attestor.streaming.responses import CONVERSATIONS, verify_stream

    rows = spark.createDataFrame([(1, 1, "assistant", "The tower stands 330 meters tall and was built by Gustave Eiffel."), (1, 0, "user", "How tall is it and who has built it in that year?")], CONVERSATIONS)
    rows.write.parquet(str(tmp_path / "in"))
    docs = spark.createDataFrame([(1, TOWER)], "doc_id long, text string")
    turns = spark.readStream.schema(CONVERSATIONS).parquet(str(tmp_path / "in"))
    verify_stream(spark, turns, docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.response_id, r.claim) for r in got] == [("1-1", "The tower stands 330 meters tall and was built by Gustave Eiffel.")]


def test_embedding_provider(spark):
    from attestor.operators.retrieval import model_cosine

    def load():
        return lambda texts: [[t.lower().count(c) + 0.1 for c in "aeiourst"] for t in texts]

    docs, said = pair(spark, TOWER, "The tower was built by Gustave Eiffel in the year of the World Fair.")
    row = verify(docs, said, Providers(semantic=model_cosine(load))).first()
    assert row.verdict in ("Hallucinated", "Uncertain", "Supported") and row.evidence


def test_a_remote_judge_needs_its_key(monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        models.remote_judge("http://localhost/none", "m", "NO_SUCH_KEY")


def test_progress(spark):
    from attestor.plans.progress import progress

    told = []
    with progress(spark, lambda message, part: told.append(part), 0.05):
        spark.range(0, 200_000, 1, 8).selectExpr("count(sha2(cast(id as string), 256))").collect()
    assert told[-1] == 1.0 and told == sorted(told)


def test_organizations_of_documents_in_any_script(spark, tmp_path):
    pattern = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})\b"
    texts = [
        "The World Bank met.",
        "À Paris, le Crédit Agricole et la Banque Populaire ont signé avec Air France.",
        "Die Deutsche Bank in München, Süd West Bank und Große Werke Nord.",
        "El Banco Nacional de España y la Caja Ruralé, éCaja Rural, Caja Rural\u0301.",
        "Banque\xa0Populaire Ouest, Air\u2003France\x85Nord, 中Air France 中 Air France文, ²Air France, _Air France, ½ Air France½",
        "Москва: Gazprom Neft и Rosneft Oil Нефть. " + "Ab Cd. " * 30,
        "no name, été",
        "",
        None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.found for r in QUERIES["fact_orgs_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else "; ".join(re.findall(pattern, t)[:20]) for i, t in enumerate(texts)}
    assert got[1] == "Banque Populaire; Air France" and got[4].startswith("Banque\xa0Populaire Ouest")


def test_of_equal_texts_the_last_of_the_nearest_brings_its_paragraph(spark):
    first, other = "Red apples grow on old trees near the river bank.", "Green pears grow in the garden behind the house."
    rest = [f"Number {w} stands for something else entirely here." for w in ("one", "two", "three", "four", "five", "six")]
    paragraphs = [[first, other, *rest[:3]], [rest[3], first, other, *rest[4:]]]
    docs = spark.createDataFrame([(1, " ".join(s for p in paragraphs for s in p))], "doc_id int, text string")
    claims = spark.createDataFrame([("r", 1, 0, f"{first[:-1]} and {other}")], "response_id string, doc_id int, claim_no int, claim string")
    hits = retrieval.hybrid(claims, passages.chunk_lists(docs)).orderBy("rank").collect()
    assert hits[0].text == f"{first} {other}" and hits[0].parent == " ".join(paragraphs[1])


def test_rounded_as_sql_engines_do(spark):
    assert 1.005 * 100 < 100.5 and 0.05625 * 10000 == 562.5
    assert [one(spark, retrieval.rounded(F.col("x"), d), x=x) for x, d in ((1.005, 2), (0.05625, 4), (-0.05625, 4))] == [1.0, 0.0563, -0.0563]


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_batches_are_cut_between_documents(rows):
    ids = [1, 1, 1, 2, 3, 3, None, None, 5]
    batches = [pa.RecordBatch.from_pydict({"doc_id": ids[lo : lo + 4], "idx": list(range(lo, min(lo + 4, 9)))}) for lo in (0, 4, 8)]
    parts = [p.to_pydict() for p in retrieval.whole_documents(iter(batches), rows)]
    assert [x for p in parts for x in p["doc_id"]] == ids and [x for p in parts for x in p["idx"]] == list(range(9))
    assert all(not set(a["doc_id"]) & set(b["doc_id"]) for a, b in zip(parts, parts[1:], strict=False))


def test_documents_are_counted_where_they_lie(spark):
    rows = [(d, i, " ".join(f"w{(d * 7 + i * j) % 5}" for j in range(4))) for d in range(40) for i in range(6)]
    chunks = spark.createDataFrame(rows, "doc_id int, idx int, text string")
    found = {kind: retrieval.index_rows(chunks, kind, block=4) for kind in retrieval.KINDS}
    for df in found.values():  # one shuffle of texts, and none of what is counted
        assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    tokens = {(d, i): t.split() for d, i, t in rows}
    blocks = {(r.doc_id, r.token, r.block): r for r in found["postings"].collect()}
    assert set(blocks) == {(d, w, i // 4) for (d, i), ws in tokens.items() for w in ws}
    for (d, w, b), r in blocks.items():
        own = {i: tokens[d, i] for i in range(b * 4, min(6, b * 4 + 4)) if w in tokens[d, i]}
        assert {e.idx: (e.f, e.len) for e in r.entries} == {i: (ws.count(w), len(ws)) for i, ws in own.items()}
        assert r.df == sum(w in tokens[d, i] for i in range(6)) and r.n == len(own) and r.most_f == max(ws.count(w) for ws in own.values())
    assert len(found["idf"].collect()) == len({(d, w) for d, w, _ in blocks})
    assert [(r.n_chunks, r.avgdl) for r in found["documents"].collect()] == [(6, 4.0)] * 40


def test_vector_search_in_tiles(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0], i % 2) for i in range(200)] + [(900, None, 0), (901, [0.0] * 3, 0)], "vec_id long, embedding array<float>, label int")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    for same in (False, True):
        one_tile, tiles = (sorted(retrieval.vector_topk(asked, vectors.coalesce(1), 8, same, block=4, tile=t).collect()) for t in (1000, 3))
        assert one_tile == tiles and len(tiles) == 80


def test_postings_hold_counts_alone(spark):
    """No names of texts and no derived lengths in an entry; white space of any kind parts tokens."""
    texts = ["One two\x85two", "two \x1c three  ONE one"]
    chunks = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")
    found = {r.token: [e.asDict() for e in r.entries] for r in retrieval.index_rows(chunks, "postings").collect()}
    assert found["two"] == [{"idx": 0, "f": 2, "len": 3, "squares": 5}, {"idx": 1, "f": 1, "len": 4, "squares": 6}]
    assert found["one"] == [{"idx": 0, "f": 1, "len": 3, "squares": 5}, {"idx": 1, "f": 2, "len": 4, "squares": 6}]
    assert set(found) == {"one", "two", "three"}


def test_claims_meet_whole_documents(spark):
    """Whatever the blocks, hits are those of an index; claims and chunks are shuffled by document, and nothing between."""
    import random

    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "rare", "the", "of", "and"]
    said = [" ".join(rng.choices(words, k=rng.randint(4, 7))).capitalize() + "." for _ in range(30)]
    texts = [(d, " ".join(rng.choices(said, k=n))) for d, n in ((1, 40), (2, 1), (3, 7), (4, 0))]
    lists = passages.chunk_lists(spark.createDataFrame(texts, "doc_id long, text string"))
    asked = [(f"r{i % 4}", i, i % 5 if i else None, " ".join(rng.choices([*words, "none"], k=rng.randint(1, 9)))) for i in range(60)] + [("s", 0, 1, ""), ("s", 1, 1, "none")]
    claims = spark.createDataFrame(asked, "response_id string, claim_no int, doc_id long, claim string")
    want = sorted(map(str, retrieval.hybrid(claims, retrieval.Index.of(lists), 3).collect()))
    for block, terms in ((64, 1_000_000), (1, 1), (5, 40)):
        found = retrieval.hybrid(claims, lists, 3, block=block, terms=terms)
        assert sorted(map(str, found.collect())) == want and len(want) > 60
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(") == 2 == plan.count("hashpartitioning(doc_id")


def test_parts_are_bounded_in_rows(spark):
    from attestor.sources.inputs import spread

    rows = spark.range(1000, numPartitions=5)
    assert [spread(rows, most).rdd.getNumPartitions() for most in (None, 1000, 100, 33)] == [5, 5, 10, 31]
    assert spread(rows, 33).agg(F.sum("id")).first()[0] == 499500


def test_opposite_weights_cancel(spark):
    """Tokens in k and in n - k chunks: the mean weight is 0 in whatever order they come, and so is a score that rests on it alone."""
    rows, n = [], 9
    for doc in range(30):
        spread = random.Random(doc).sample(range(1, n), n - 1)
        rows += [(doc, i, " ".join(f"d{doc}t{k}" for k in spread if i < k)) for i in range(n - 1)] + [(doc, n - 1, "")]
    chunks = spark.createDataFrame(rows, "doc_id int, idx int, text string").coalesce(1)
    index = retrieval.Index(retrieval.index_rows(chunks, "postings"), retrieval.index_rows(chunks, "documents"), chunks)
    assert [r.mean_idf for r in index.stats.collect()] == [0.0] * 30
    claims = spark.createDataFrame([(f"r{doc}", 0, doc, f"d{doc}t8 d{doc}t6") for doc in range(30)], "response_id string, claim_no int, doc_id int, claim string")
    scores = [r.bm25 for r in retrieval.shared_scores(claims, index).collect()]
    assert len(scores) == 30 * 8 and set(scores) == {0.0}


def test_weights_are_those_of_the_c_library(spark):
    """Normalized scores lie on halves where a last bit decides; a store without weights still has them counted."""
    n = 60
    chunks = spark.createDataFrame([(1, i, " ".join(f"t{k}" for k in range(1, n) if i < k) or "none") for i in range(n)], "doc_id int, idx int, text string")
    blocks, stats = retrieval.index_rows(chunks, "postings"), retrieval.index_rows(chunks, "documents")
    claims = spark.createDataFrame([("r", 0, 1, " ".join(f"t{k}" for k in range(1, n // 2)))], "response_id string, claim_no int, doc_id int, claim string")
    found = lambda blocks: {int(r.token[1:]): r.idf for r in retrieval.weighed_terms(claims, blocks, stats).collect()}
    want = {k: math.log(n - k + 0.5) - math.log(k + 0.5) for k in range(1, n // 2)}
    assert found(blocks) == want
    assert found(blocks.withColumn("idf", F.lit(None).cast("double"))) == pytest.approx(want)
