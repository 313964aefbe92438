"""Names found in whole texts by automata, against Python's own search and the comparison of facts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import facts as K
from attestor.operators import mentions

TEXTS = "doc_id string, text string"


def brute(texts, names):
    out = []
    for doc_id, text in texts:
        for name in {n.lower() for n in names if n}:
            low = (text or "").lower()
            at = [i for i in range(len(low)) if low.startswith(name, i)]
            if at:
                out.append((doc_id, name, len(at), at[0] + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 64, 1])
def test_all_names_are_found_whatever_the_blocks(spark, block_bytes):
    """Names within names, names that overlap themselves and others, other scripts, nulls, empty and repeated rows."""
    rng = random.Random(5)
    names = ["a", "aa", "aba", "abab", "ab ab", "\u00e9\u4e2d", "Zq", "zQ", "", None, "not there", *("".join(rng.choices("ab ", k=rng.randint(1, 4))) for _ in range(20))]
    texts = [(str(i), "".join(rng.choices("abAB \u00e9\u4e2dz\U0001f600q", k=rng.choice([0, 5, 60])))) for i in range(40)]
    texts += [(None, "abab"), ("null", None), ("twice", "ab"), ("twice", "ab"), ("long", "ab" * 3000 + "zq")]
    got = mentions.mentions(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame([(n,) for n in names], "name string"), block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts, names)


def test_no_names_or_texts(spark):
    texts, names = spark.createDataFrame([("1", "a b c")], TEXTS), spark.createDataFrame([(None,), ("",)], "name string")
    assert mentions.mentions(texts, names).collect() == []
    assert mentions.mentions(texts.limit(0), spark.createDataFrame([("a",)], "name string")).collect() == []


def test_unknown_organizations_are_those_of_the_comparison(spark):
    """The same names as fact comparison gives, where the source is the whole text."""
    orders = spark.createDataFrame([(k,) for k in range(1, 60)], "o_orderkey long").withColumn("o_orderdate", F.lit("1999-01-01").cast("date"))
    names = ["Health Organization Of Peru", "World Bank", "Acme Widget Works", "acme Widget Works Ltd"]
    rows = orders.select(F.col("o_orderkey").alias("id"), *[F.concat_ws(" and the ", *[F.when(F.hash("o_orderkey", F.lit(n + side)) % 2 == 0, F.lit(n)) for n in names]).alias(side) for side in ("source", "claim")])
    own, of = K.facts(F.col("claim"), names=K.OF_CLAIM, organization_limit=None), K.facts(F.col("source"), names=K.OF_SOURCE)
    compared = rows.select("id", own.alias("own"), of.alias("of"), "source").select("id", F.explode(dict(K.signals(F.col("own"), F.col("of"), F.col("source")))["organization"]).alias("said"))
    expected = {(r.id, r.said.split("'")[1]) for r in compared.collect()}
    claims = rows.select(F.col("id").alias("response_id"), F.lit(0).alias("claim_no"), F.col("id").alias("doc_id"), "claim")
    docs = rows.select(F.col("id").alias("doc_id"), F.col("source").alias("text"))
    got = mentions.unknown_organizations(claims, docs, block_bytes=20).collect()
    assert {(r.response_id, r.name) for r in got} == expected and len(got) == len(expected) > 10
    # more names than the comparison's limit, and a claim whose document isn't there
    many = " and ".join(f"Bank Of {chr(65 + i)}{'abcdefghij'[i % 10] * 3}" for i in range(26))
    lone = spark.createDataFrame([("r", 0, "gone", many + " and World Bank")], "response_id string, claim_no int, doc_id string, claim string")
    assert mentions.unknown_organizations(lone, spark.createDataFrame([("d", many)], TEXTS)).count() == 26
    here = lone.withColumn("doc_id", F.lit("d"))
    assert mentions.unknown_organizations(here, spark.createDataFrame([("d", many.upper())], TEXTS)).count() == 0


def test_texts_are_searched_in_their_own_partitions(spark):
    """Names are broadcast, texts stay where they are: the plan has no exchange."""
    texts = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit("a b c").alias("text"))
    got = mentions.mentions(texts, spark.createDataFrame([("a b",)], "name string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 100
