"""Prefix trie of conversations: chained digests, grouped to nodes, with sums over subtrees.

Each turn has a digest of its role and text, each prefix the SHA-256 of its parent's digest and its last turn's. Prefixes
of one (depth, digest) are one node, which belongs to its smallest conversation. What a conversation owns is the lower
end of its path, so it sends each of its ancestors one row with the sum of what it owns at or below: subtree sums take as
many rows as there are turns, not the square of a conversation's length. Texts are never shuffled, only digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import table, written

#: Conversation ids whose members end at a node are joined to texts by runs of so many ids, which are hashed one after another.
RUN_IDS = 4096
#: Parents of more children than this, or than a 10,000th of all nodes, are broadcast: 10,000 rows at most.
MANY_CHILDREN, MOST_BROADCAST = 1000, 10_000
#: A rebuilt conversation borrows up to LONGEST_LOAN turns from the first one of its block of ids.
BLOCK_IDS, LONGEST_LOAN = 100, 5

PREFIXES = "conv_id bigint, depth int, digest binary, parent binary, chars bigint, last boolean"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), content (a digest of role and text) and chars of each of turns(conv_id, turn, role, text).

    Turns are ordered by turn, nulls first, those of one turn by role and then by content. A null role or text is empty,
    rows without conv_id belong to no conversation, repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), content.alias("content"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "content")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "content", "chars")


def rebuilt(rows: DataFrame, block: int = BLOCK_IDS, longest: int = LONGEST_LOAN) -> DataFrame:
    """rows of numbered(), each conversation's first h turns replaced by those of the first conversation of its block.

    h is the CRC-32 of its decimal id modulo longest + 1. Each conversation also has a row of place 0 without content, so
    that one without turns is there too.
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    loan = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    starts = rows.select("conv_id").distinct()
    own = rows.where(F.col("place") > loan)
    lent = rows.where((F.col("conv_id") % block == 0) & (F.col("place") <= longest)).withColumnRenamed("conv_id", "base")
    # at most `longest` rows meet at most two blocks of conversations under one key
    borrowed = starts.withColumn("base", base).withColumn("loan", loan).join(lent, "base").where("place <= loan").select("conv_id", "place", "content", "chars")
    empty = starts.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(borrowed).unionByName(empty)


def prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation of rows(conv_id, place, content, chars), from depth 0.

    A conversation is read as a stream, so its length isn't bounded by memory. last marks the whole conversation. Places
    order the turns and may have gaps; a row without content is no turn.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])
        root = hashlib.sha256(b"").digest()
        held = None  # the prefix that isn't known to be the last yet
        for batch in batches:
            out = []
            for conv, content, chars in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is None or held[0] != conv:
                    if held:
                        out.append((*held, True))
                    held = (conv, 0, root, None, 0)
                if content is not None:
                    out.append((*held, False))
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + content).digest(), held[2], chars)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=schema.field(i).type) for i in range(6)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((*held, True), schema, strict=True)], schema=schema)

    ordered = rows.select("conv_id", "place", "content", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(chain, PREFIXES)


def ends(paths: DataFrame, run_ids: int = RUN_IDS) -> DataFrame:
    """digest and ends_sha256 of each node at which a conversation of prefixes() ends.

    The ids of a node are joined in runs of up to run_ids, and a node's runs are hashed as a stream.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest == last:
                    state.update(b",")
                else:
                    if state:
                        out.append((last, state.hexdigest()))
                    last, state = digest, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type=pa.binary()), pa.array([r[1] for r in out], type=pa.string())], names=["digest", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], type=pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    run = F.floor(F.col("conv_id") / F.lit(run_ids)).alias("run")
    runs = paths.where("last").groupBy("digest", run).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("digest", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return runs.repartition("digest").sortWithinPartitions("digest", "run").mapInArrow(hashed, "digest binary, ends_sha256 string")


def nodes(paths: DataFrame) -> DataFrame:
    """depth, digest, parent, chars, conv_id (smallest member), n_convs and n_children of each node of prefixes()."""
    # what depends on the digest is a key too, so that only numbers are aggregated, in hash tables before the shuffle
    made = paths.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    kids = made.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    return made.join(kids, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def subtree_sums(paths: DataFrame, found: DataFrame) -> DataFrame:
    """digest, n_leaves and saved_tokens: what each node's subtree sums up to."""
    own = found.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = paths.select("conv_id", "depth", "digest").join(own, ["conv_id", "depth"], "left")
    sent = path.select("digest", F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaves")).where("leaves is not null")
    return sent.groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def with_parents(found: DataFrame, total: int) -> DataFrame:
    """Adds parent_conv_id to nodes. Parents of many children are broadcast, so no join key has many rows."""
    few = max(MANY_CHILDREN, total // MOST_BROADCAST)
    tops = found.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(tops.where(F.col("n_children") > few).select("parent", "parent_conv_id"))
    cold = tops.where(F.col("n_children") <= few).select("parent", "parent_conv_id")
    return found.join(hot, "parent").unionByName(found.join(hot, "parent", "left_anti").join(cold, "parent", "left"))


def trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations in rows(conv_id, place, content, chars), a row for each node.

    conv_id is the smallest member's; depth; parent_conv_id is the parent's conv_id (root: null); n_convs members; n_children;
    n_leaves and saved_tokens are sums over the subtree; ends_sha256 digests the ids of the members that end there. Without
    conversations there is no node.
    """
    paths = written(prefixes(rows), "prefixes")
    found = written(nodes(paths), "nodes")
    out = with_parents(found, found.count()).join(subtree_sums(paths, found), "digest").join(ends(paths), "digest", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    numbers = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*numbers, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by blocks of a hundred ids; nulls, ties and repeated rows as in numbered(); other columns are not read."""
    return trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))


#: The same by lists of whole turns instead of digests.
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS v FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(v ORDER BY place) AS turns FROM t GROUP BY c),
loans AS (SELECT c, turns, c - c % 100 AS base, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS BIGINT) AS h FROM own),
conv AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns FROM loans a LEFT JOIN own b ON b.c = a.base),
path AS (SELECT c, d, turns[1 : d] AS p, len(turns) AS n FROM conv, unnest(range(0, len(turns) + 1)) AS r(d)),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM path GROUP BY d, p),
linked AS (SELECT k.*, u.conv_id AS parent_conv_id FROM node k LEFT JOIN node u ON u.d = k.d - 1 AND u.p = k.p[1 : k.d - 1]),
kids AS (SELECT conv_id, d, count(*) AS n FROM (SELECT parent_conv_id AS conv_id, d - 1 AS d FROM linked WHERE d > 0) GROUP BY ALL),
full_node AS (SELECT l.*, coalesce(k.n, 0) AS n_children, CASE WHEN l.d = 0 THEN 0 ELSE (n_convs - 1) * length(l.p[-1].text) END AS saved FROM linked l LEFT JOIN kids k ON k.conv_id = l.conv_id AND k.d = l.d),
sums AS (SELECT a.d, a.p, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved_tokens FROM full_node f, unnest(range(0, f.d + 1)) AS r(u) JOIN node a ON a.d = r.u AND a.p = f.p[1 : r.u] GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_node f JOIN sums s ON s.d = f.d AND s.p = f.p
"""
