"""Importance resampling towards a target distribution by hashed n-grams, in DataFrame operations only.

Each text becomes an array of bucket numbers once, which is stored. Grouped counts of the exploded buckets of corpus and
target give a gain for each bucket, a table of as many rows as there are buckets, which is broadcast; a document's weight
is the sum of its features' gains. Rows are then sorted by noisy weight over all partitions, and a row's rank is its
place in its partition after the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import discard, table, written

LONGEST, BUCKETS = 1, 10_000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: The gain table has a row for each bucket, 16 bytes each: it is broadcast up to this many.
MOST_BUCKETS = 1 << 20

# What stands between words, and the letters that are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, with A to Z in lower case; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), lambda w: w != "")


def buckets(words: Column, longest: int = LONGEST, n_buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to longest consecutive words, repeats counted."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % n_buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *(runs(n) for n in range(2, longest + 1)))


def hashed(docs: DataFrame, name: str, longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words and buckets of each row of docs(doc_id, text), written to storage; row tells rows apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words"))
    return written(rows.select("row", "doc_id", F.size("words").alias("n_words"), buckets(F.col("words"), longest, n_buckets).alias("buckets")), name)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket and n of all features."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain for every bucket: a thousand times the smoothed log ratio of target to corpus, rounded down."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(corpus.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    per = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = per.agg(F.sum("s"), F.sum("t")).first()
    number = lambda c: F.col(c).cast("double")
    ratio = ((number("t") + 1) * F.lit(float(all_s + n_buckets))) / ((number("s") + 1) * F.lit(float(all_t + n_buckets)))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel noise in thousandths, rounded down; a null doc_id counts as an empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, n_buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs(doc_id, text), drawn towards target(text).

    Of the rows with least_words or more, percent (rounded down) of the highest scores have a rank from 1, ties go to the
    smaller doc_id (nulls first), then to an arbitrary but fixed row; all others have none. Null and empty texts have no
    features and weight 0, repeated rows are rows of their own. An empty corpus or target has no counts.
    """
    if not 0 < n_buckets <= MOST_BUCKETS:
        raise ValueError(f"n_buckets must be from 1 to {MOST_BUCKETS}, not {n_buckets}")
    rows = hashed(docs, "features", longest, n_buckets)
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target", longest, n_buckets)
    table_of_gains = written(gains(bucket_counts(rows), bucket_counts(wanted), n_buckets), "gains")
    discard(wanted)
    each = rows.select("row", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(table_of_gains), "bucket", "left")
    # rows of one document follow one another, so a task sends one row for each
    weighed = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    ranked = written(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    discard(rows, table_of_gains)
    return _with_ranks(ranked, percent)


def _with_ranks(ranked: DataFrame, percent: int) -> DataFrame:
    """Ranks of rows sorted over all partitions, whose place holds the partition and the row there."""
    part = F.shiftright("place", 33)
    counts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))
    # one row a partition
    ahead, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.floor(F.sum("n_eligible").over(every) * percent / 100).alias("drawn"))
    placed = ranked.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (rank <= F.col("drawn")), rank).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of documents, with benchmark as the target, as resampled() has them; other columns are not read."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FEATURES = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, CAST(octet_length(encode(w)) AS BIGINT) + 1), lambda i: CAST('0x' || hex(encode(w))[2 * i - 1 : 2 * i] AS BIGINT))), "
    "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
)
#: The same with the checksum written out, each distinct word hashed once.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_FEATURES}, []) AS w FROM documents), b AS (SELECT coalesce({_FEATURES}, []) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM d), g AS (SELECT unnest(w) AS w FROM b),
known AS (SELECT w, CAST({_CRC} % 10000 AS BIGINT) AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN known USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN known USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
summed AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN known USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('2024:' || d.doc_id), 8) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN summed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
