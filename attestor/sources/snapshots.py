"""A table of appended Parquet folders with deletion records and a manifest for each version, merged when it is read.

A commit writes folders of its own and then one small manifest that names all folders of the new version. The manifest is
renamed into place, so a version is there as a whole or not at all, and a version that another writer has taken is tried
again as the next. Rows carry the name of their folder; a deletion record ends the rows of its key in folders that were
committed before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.scratch import remove

#: Times that a commit is tried again after another writer's.
TRIES = 20
#: Bits per entry of a folder's Bloom filters follow from this many expected keys.
KEYS_EXPECTED = 100_000


@dataclass
class Commit:
    """Folders of one commit by part, the folder of keys that it ends, and its place in the order of commits."""

    order: int
    rows: dict[str, str] = field(default_factory=dict)
    ended: str | None = None


class SnapshotTable:
    """Parts (name: schema) that share a key column, in one folder. Every read is of one version, by default the latest."""

    def __init__(self, spark: SparkSession, path: str, parts: dict[str, str], key: str = "doc_id"):
        self.spark, self.path, self.parts, self.key = spark, path.rstrip("/"), parts, key

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def exists(self, path: str) -> bool:
        fs, found = self._fs(path)
        return fs.exists(found)

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def commits(self, version: int | None = None) -> list[Commit]:
        """The commits that a version consists of; none before the first."""
        known = self.versions()
        if version is None and not known:
            return []
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        fs, file = self._fs(f"{self.path}/versions/{known[-1] if version is None else version:08d}.json")
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Commit(**c) for c in json.loads(text)]

    def _publish(self, version: int, commits: list[Commit]) -> bool:
        """Whether the version is now there as given; false if another writer was first."""
        fs, final = self._fs(f"{self.path}/versions/{version:08d}.json")
        _, aside = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps([asdict(c) for c in commits]).encode()))
        finally:
            stream.close()
        try:
            done = not fs.exists(final) and fs.rename(aside, final)
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)
        return bool(done)

    def _written(self, rows: DataFrame, kind: str, ordered: bool = False) -> str:
        """The new folder of rows, sorted by key within each file (unless they are so already), with Bloom filters on the key."""
        name = f"{kind}-{uuid.uuid4().hex[:16]}"
        try:
            options = {f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": str(KEYS_EXPECTED)}
            rows = rows if ordered else rows.sortWithinPartitions(self.key)
            rows.withColumn("batch", F.lit(name)).write.options(**options).parquet(f"{self.path}/data/{name}", compression="zstd")
        except BaseException:
            remove(self.spark, f"{self.path}/data/{name}")
            raise
        return name

    def commit(self, rows: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None, ended: DataFrame | str | None = None) -> int | None:
        """Adds rows to parts and ends what earlier commits hold of the keys in ended; gives the new version.

        What is written is written once, before the version is published; a failure before that changes nothing. A part
        may be a function of what the parts before it have written, by name, which gives rows sorted by key; so may ended be the name of a part, whose keys
        end. If the first part has no rows, nothing is published.
        """
        made = Commit(0)
        names = []
        fresh = lambda part: self.spark.read.schema(self._schema(part)).parquet(f"{self.path}/data/{made.rows[part]}")
        try:
            for part, df in (rows or {}).items():
                if ordered := callable(df):
                    df = df(fresh)
                made.rows[part] = self._written(df.select(*[F.col(c).cast(t) for c, t in self._columns(part)]), part, ordered)
                names.append(made.rows[part])
                if len(names) == 1 and fresh(part).isEmpty():
                    remove(self.spark, f"{self.path}/data/{names[0]}")
                    return None
            if isinstance(ended, str):
                ended = fresh(ended)
            if ended is not None and self.commits():  # there is nothing to end in an empty table
                made.ended = self._written(ended.select(F.col(self.key).cast(dict(self._columns(next(iter(self.parts))))[self.key]).alias(self.key)).distinct(), "ended")
                names.append(made.ended)
            return self._append(made)
        except BaseException:
            for name in names:
                remove(self.spark, f"{self.path}/data/{name}")
            raise

    def _append(self, made: Commit) -> int:
        for _ in range(TRIES):
            known = self.versions()
            version = known[-1] + 1 if known else 1
            before = self.commits(known[-1]) if known else []
            made.order = max((c.order for c in before), default=0) + 1
            if self._publish(version, [*before, made]):
                return version
        raise RuntimeError(f"{self.path}: other writers took {TRIES} versions")

    def _columns(self, part: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self._schema(part)]

    def _schema(self, part: str):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.parts[part])

    def read(self, part: str, version: int | None = None) -> DataFrame:
        """The live rows of a part. Without deletion records after its first folder nothing is joined."""
        commits = self.commits(version)
        schema = self._schema(part)
        folders = {c.rows[part]: c.order for c in commits if part in c.rows}
        ended = {c.ended: c.order for c in commits if c.ended}
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(self._with_batch(schema)).parquet(*[f"{self.path}/data/{f}" for f in folders])
        later = {name: order for name, order in ended.items() if order > min(folders.values())}
        if not later:
            return rows.drop("batch")
        # as many folders as commits since the last compaction
        order_of = lambda orders: F.element_at(F.create_map(*[F.lit(x) for pair in orders.items() for x in pair]), F.col("batch"))
        key = self._schema(part)[self.key]
        gone = self.spark.read.schema(self._with_batch([key])).parquet(*[f"{self.path}/data/{f}" for f in later])
        gone = gone.select(F.col(self.key).alias("ended_key"), order_of(later).alias("ended_at")).groupBy("ended_key").agg(F.max("ended_at").alias("ended_at"))
        rows = rows.withColumn("added_at", order_of(folders))
        return rows.join(gone, (F.col(self.key) == F.col("ended_key")) & (F.col("added_at") < F.col("ended_at")), "left_anti").drop("batch", "added_at")

    @staticmethod
    def _with_batch(fields):
        from pyspark.sql.types import StructType

        return StructType(list(fields)).add("batch", "string")

    def compact(self) -> int:
        """A version of the same rows in one folder a part, without deletion records. Older versions can still be read."""
        known = self.versions()
        if not known:
            raise ValueError("nothing was ever written")
        commits = self.commits(known[-1])
        made = Commit(max(c.order for c in commits), {part: self._written(self.read(part, known[-1]), part) for part in self.parts if any(part in c.rows for c in commits)})
        if not self._publish(known[-1] + 1, [made]):
            for name in made.rows.values():
                remove(self.spark, f"{self.path}/data/{name}")
            raise RuntimeError(f"{self.path}: another writer was first")
        return known[-1] + 1

    def vacuum(self) -> list[str]:
        """Removes older versions, and all folders that the latest doesn't name; no reader or writer may be at work."""
        known = self.versions()
        kept = {name for c in self.commits() for name in [*c.rows.values(), c.ended] if name}
        for version in known[:-1]:
            remove(self.spark, f"{self.path}/versions/{version:08d}.json")
        fs, folder = self._fs(f"{self.path}/data")
        found = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = sorted(set(found) - kept)
        for name in gone:
            remove(self.spark, f"{self.path}/data/{name}")
        return gone
