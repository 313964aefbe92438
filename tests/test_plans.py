"""Literal facts and replies, report files, stages with progress, batches of an entailment model, chunks in the row."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from attestor.functions import facts as K
from attestor.functions import rows as R
from attestor.operators import models, passages
from attestor.operators.summary import reports, summaries
from attestor.plans import sql as S
from attestor.plans.progress import verify_in_stages
from attestor.plans.verify import verify
from attestor.sources.reports import read_reports, write_reports

FACT_TEXTS = [
    "In 2019 the World Health Organization said 40% of patients in 12 countries recovered.",
    "In 1999 the World Trade Organization confirmed that 75% of patients in 30 countries always recovered.",
    "It grew by 3.5 % in 1889 and 1,234 users of 0012 companies never left.",
    "The Eiffel Tower stands in Paris. Every tower is officially global, global and proven.",
    "No facts here at all.",
    "",
]
FACT_PAIRS = [
    (FACT_TEXTS[0], FACT_TEXTS[1]),
    (FACT_TEXTS[0], "In 2001 the World Health Organization said 40% of patients in 12 countries recovered."),
    ("The program helped patients in many places.", "The program helped 50% of patients."),
    ("It ran in 1,000 countries.", "It ran in 5,000 countries."),
    ("It had 12 countries and 007 users.", "It had 99999999999999999999 countries and 7 users and 8 users."),
    ("Growth was 50 % in one place, 20% in another, 5% and 7%.", "Growth was 50% in 1987."),
]
REPLIES = [
    "REASONING: a\nb\nVERDICT: HALLUCINATED\nCONFIDENCE: HIGH\nCORRECTION: x",
    "**VERDICT:** HALLUCINATED",
    "VERDICT: SUPPORTED\nVERDICT: HALLUCINATED",
    "VERDICT: [HALLUCINATED]",
    "  CONFIDENCE: LOW \nCORRECTION: CORRECTION: y\n VERDICT: SUPPORTED",
    "",
]


def of_duck(rows, names, query):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE given (id BIGINT, {', '.join(n + ' VARCHAR' for n in names)})")
    con.executemany(f"INSERT INTO given VALUES (?{', ?' * len(names)})", [(i, *r) for i, r in enumerate(rows)])
    return con.execute(query).fetchall()


@pytest.mark.parametrize("name", ["percentages", "numbers", "years", "absolutes", "stat_claims", "scale_claims", "organizations"])
def test_facts_of_literal_texts(spark, name):
    flat = F.col(f"f.{name}")
    flat = F.transform(flat, lambda x: F.concat(x["a"], F.lit("|"), x["b"])) if name.endswith("claims") else flat
    df = spark.createDataFrame(list(enumerate(FACT_TEXTS)), "id long, text string").select("id", K.facts(F.col("text")).alias("f"))
    got = {r.id: r.found for r in df.select("id", F.array_join(flat, "; ").alias("found")).collect()}
    assert got == dict(of_duck([(t,) for t in FACT_TEXTS], ["text"], f"SELECT id, array_to_string({S.facts_sql('text')[name]}, '; ') FROM given"))


def test_fact_points_of_literal_pairs(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(FACT_PAIRS)], "id long, source string, claim string")
    own = df.withColumn("own", K.facts(F.col("claim"), names=K.OF_CLAIM)).withColumn("of_source", K.facts(F.col("source"), names=K.OF_SOURCE))
    got = sorted((r.id, r.c.points, list(r.c.signals)) for r in own.select("id", K.compared(F.col("own"), F.col("of_source"), F.col("source")).alias("c")).collect())
    assert got == sorted(of_duck(FACT_PAIRS, ["source", "claim"], f"WITH {S.compare_cte('given')} SELECT id, points, signals FROM compared"))
    assert [points for _, points, _ in got][2:4] == [30, 0]  # "1,000 countries" reads as "000 countries"


def test_literal_replies(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "id long, raw string")
    got = {r.id: tuple(r)[1:] for r in df.select("id", *models.parsed_reply(F.col("raw"))).collect()}
    want = of_duck([(r,) for r in REPLIES], ["raw"], "SELECT id, " + ", ".join(S.REPLY_SQL.values()) + " FROM given")
    assert got == {r[0]: r[1:] for r in want} and got[0] == ("a", "HALLUCINATED", "HIGH", "x") and got[5] == ("", "UNKNOWN", "LOW", "N/A")


TEXT = "The tower stands 330 meters tall in the city. It was built by Gustave Eiffel in the year 1889. It is visited by many people from all countries."
SAID = [("r/1", "a", "The tower stands 330 meters tall and was built by Gustave Eiffel."), ("r2", "a", "It is visited by seven million people in every year of the century."), ("r3", "none", "A claim about a document that nobody has ever stored here."), ("r4", "a", "Short.")]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame([("a", TEXT)], ["doc_id", "text"]), spark.createDataFrame(SAID, ["response_id", "doc_id", "text"])


def test_reports_are_replaced_file_by_file(spark, given, tmp_path):
    verdicts = verify(*given)
    made = reports(verdicts, summaries(verdicts, given[1])).cache()
    out = str(tmp_path / "reports")
    write_reports(made, out)
    want = {r.response_id: r.report for r in made.collect()}
    files = sorted((tmp_path / "reports").rglob("*.txt"))
    assert len(files) == len(want) == 4 and {r.response_id: r.report for r in read_reports(spark, out).collect()} == want
    kept = {f: f.stat().st_mtime_ns for f in files if "response_id=r3" in str(f)}
    write_reports(made.where("response_id <> 'r3'").withColumn("report", F.when(F.col("response_id") == "r2", None).otherwise(F.col("report"))), out)
    assert {r.response_id: r.report for r in read_reports(spark, out).collect()} == want | {"r2": ""}
    assert {f: f.stat().st_mtime_ns for f in kept} == kept and len(list((tmp_path / "reports").rglob("*.txt"))) == 4


def test_stages_tell_the_rows_that_they_made(given):
    told = []
    got = verify_in_stages(*given, lambda *x: told.append(x))
    assert sorted(map(str, got.collect())) == sorted(map(str, verify(*given).collect()))
    assert [x[:2] for x in told] == [("claims", 0.25), ("hits", 0.5), ("evidence", 0.75), ("verdicts", 1.0)]
    assert told[0][2] == told[3][2] == 3 and told[2][2] == 2 and told[1][2] >= 2


def test_pairs_of_one_length_share_a_batch_and_only_premises_are_cut(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def model(parents, claims):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(f"{p}|{c}" for p, c in zip(parents, claims, strict=True)))
            return [("NEUTRAL", 0.5)] * len(parents)

        return model

    pairs = [(" ".join(["w"] * (1 + i * 7 % 40)), f"claim {i}") for i in range(40)]
    hits = spark.createDataFrame([(str(i % 3), p, c) for i, (p, c) in enumerate(pairs + pairs[:5])], "response_id string, parent string, claim string")
    assert len(models.entailment_by_model(hits.repartition(4), load, batch=4, limit=20).collect()) == 45
    batches = [[line.split("|") for line in f.read_text().split("\n")] for f in tmp_path.iterdir()]
    assert sorted(c for b in batches for _, c in b) == sorted(c for _, c in pairs) and max(map(len, batches)) == 4
    assert all(len(p.split()) == min(len(dict((c, p) for p, c in pairs)[c].split()), 18) for b in batches for p, c in b)
    spans = [max(len(p.split()) for p, _ in b) - min(len(p.split()) for p, _ in b) for b in batches]
    assert sum(spans) / len(spans) <= 4


def test_arrays_are_made_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    parts = F.filter(F.split("text", " "), lambda x: x != "")
    assert sorted(map(tuple, R.exploded(df, ["id"], parts, "w", "at").collect())) == [(1, 0, "a"), (1, 1, "b")]
    assert sorted(map(tuple, R.once(df, ["id"], n=F.size(parts)).na.fill(-1).collect())) == [(1, 2), (2, 0), (3, -1)]
    plan = passages.sentences(df.withColumnRenamed("id", "doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
