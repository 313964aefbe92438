"""Names in whole texts: all names of a block are found in one pass over each text, by an Aho-Corasick automaton.

Names are distinct strings, dealt by hash into blocks of bounded bytes. A block is broadcast, each task makes its automaton once,
and each text is read once a block however many names there are. Only what was found is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import facts
from attestor.functions.rows import exploded
from attestor.sources.scratch import discard, stored

#: Bytes of the names of a block, about; its automaton takes some fifty times as many.
BLOCK_BYTES = 4 << 20
FOUND = "doc_id string, name string, n_places bigint, first_at bigint"


def automaton(names: list[str]):
    """The automaton of distinct, non-empty names, which gives a name's number and length where it ends."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, name in enumerate(names):
        made.add_word(name, (i, len(name)))
    made.make_automaton()
    return made


def places(made, text: str) -> dict[int, list[int]]:
    """[how often, first place from 1] of each name in a text, by number; places may overlap."""
    out: dict[int, list[int]] = {}
    for end, (i, size) in made.iter(text):
        if i in out:
            out[i][0] += 1
        else:
            # places of one name are met in their order
            out[i] = [1, end - size + 2]
    return out


def mentions(texts: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, name, n_places and first_at (code points from 1) of each of names(name) in each of texts(doc_id, text) that has it.

    Letters of either case are equal, so name comes in lower case; a name needs no word's borders, as with contains(). doc_id is
    a string. Null and empty names are none, repeated names are one; a null text has no names. Each row of texts is searched
    by itself, so a repeated row has its names again. Without names or texts there is nothing.
    """
    lowered = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
    known = stored(lowered.withColumn("size", F.octet_length("name") + 1), "names")
    blocks = -(-(known.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    rows = texts.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.lower("text").alias("text"))
    found = None
    for block in range(blocks):
        own = [r.name for r in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).select("name").collect()]
        if not own:
            continue
        shared = known.sparkSession.sparkContext.broadcast(own)
        part = rows.mapInArrow(_searched(shared), FOUND)
        if blocks > 1:
            # one block's names are held at a time
            part = stored(part, "mentions")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    discard(known)
    return texts.sparkSession.createDataFrame([], FOUND) if found is None else found


def _searched(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        made = automaton(names)
        for batch in batches:
            ids, which, often, first = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for i, (n, at) in places(made, text.as_py()).items():
                    ids.append(doc_id.as_py())
                    which.append(names[i])
                    often.append(n)
                    first.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(which, pa.string()), pa.array(often, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "name", "n_places", "first_at"])

    return search


def named(rows: DataFrame, column: str, keep: list[str], any_script: bool = False) -> DataFrame:
    """keep and a row for each organization in a text column that has enough words to be checked, repeats included."""
    found = facts.organizations(F.col(column), any_script, most=None)
    return exploded(rows, keep, F.filter(found, facts.is_checked), "name")


def unknown_organizations(claims: DataFrame, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """response_id, claim_no, doc_id and name of each organization in claims(response_id, claim_no, doc_id, claim) that its document lacks.

    The whole text of docs(doc_id, text) counts, not only what retrieval finds for the claim, and all names of a claim are
    checked. A name that a claim repeats is one row, written as in the claim. A claim without a document has all its names.
    """
    asked = named(claims, "claim", ["response_id", "claim_no", "doc_id"]).distinct()
    asked = asked.withColumns({"of_doc": F.col("doc_id").cast("string"), "lowered": F.lower("name")})
    # documents that no claim asks about aren't searched
    own = docs.join(claims.select("doc_id").distinct(), "doc_id", "left_semi")
    found = mentions(own, asked.select("name"), block_bytes).select(F.col("doc_id").alias("of_doc"), F.col("name").alias("lowered")).distinct()
    return asked.join(found, ["of_doc", "lowered"], "left_anti").select("response_id", "claim_no", "doc_id", "name")
