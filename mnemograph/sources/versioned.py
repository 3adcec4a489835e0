"""Tables published in versions, part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemograph.session import versions

#: Pointers that were read; one that is complete never changes.
_POINTERS: dict[str, dict[str | None, int]] = {}


class Versioned:
    """A table partitioned by one column, whose versions share the parts that they don't change.

    ``publish`` writes the parts that change under the folder of the version and then a small
    pointer table that tells for every part which version holds it. The pointer's ``_SUCCESS`` file is the
    switch: before it is there readers see the version before, and nothing that a reader may hold is ever overwritten.
    Publishing a version again that is there already does nothing, so a repeated batch is harmless;
    what a failed attempt left is overwritten by the next. What a version reads and writes depends on
    the parts it touches, not on the number of versions; ``prune`` removes what no kept version points to.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str):
        """``schema`` includes the column ``part``."""
        self.spark, self.path, self.schema, self.part = spark, path, schema, part

    def numbers(self, before: int | None = None) -> list[int]:
        return [n for n in versions(self.spark, f"{self.path}/pointer") if before is None or n < before]

    def pointer(self, version: int | None = None, before: int | None = None) -> dict[str | None, int]:
        """Part -> version that holds it; of the latest version, or of ``version``."""
        known = self.numbers(before)
        if version is None and not known:
            return {}
        path = f"{self.path}/pointer/version={known[-1] if version is None else version}"
        if path not in _POINTERS:
            _POINTERS[path] = {r.part: r.held for r in self.spark.read.schema("part string, held int").parquet(path).collect()}
        return dict(_POINTERS[path])

    def _folder(self, part: str | None, held: int) -> str:
        paths = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return f"{self.path}/data/version={held}/{paths.getPartitionPathString(self.part, part)}"

    def publish(self, rows: DataFrame, version: int, replaced: list | None = None, dealt: bool = True) -> None:
        """``rows`` are the whole new content of their parts; parts in ``replaced`` without rows become empty.

        Rows of all one part need not be ``dealt``: they are written by the tasks that have them.
        """
        if version in self.numbers():
            return
        folder = f"{self.path}/data/version={version}"
        rows = rows.hint("rebalance", self.part) if dealt else rows
        rows.write.mode("overwrite").partitionBy(self.part).parquet(folder)
        now = self.pointer(before=version)
        for part in replaced or []:
            now.pop(None if part is None else str(part), None)
        now.update(dict.fromkeys(self._written(folder), version))
        table = self.spark.createDataFrame(list(now.items()), "part string, held int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/version={version}")

    def _written(self, folder: str) -> list[str | None]:
        """Parts that a data folder holds, by the names of its folders."""
        jvm = self.spark._jvm
        path, names = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        values = [f.getPath().getName().split("=", 1)[1] for f in found if f.isDirectory() and "=" in f.getPath().getName()]
        return [None if v == names.DEFAULT_PARTITION_NAME() else names.unescapePathName(v) for v in values]

    def read(self, version: int | None = None, before: int | None = None, only: list | None = None) -> DataFrame:
        """The table as of a version (the latest, or the latest ``before`` one); only the parts in ``only``, if given."""
        wanted = None if only is None else {None if p is None else str(p) for p in only}
        held = {p: n for p, n in self.pointer(version, before).items() if wanted is None or p in wanted}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(f"{self.schema}, version int").option("basePath", f"{self.path}/data")
        return reader.parquet(*[self._folder(p, n) for p, n in held.items()]).drop("version")

    def prune(self, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions; nothing may read the removed ones any more."""
        known = self.numbers()
        gone, kept = known[:-keep], known[-keep:]
        live = {item for n in kept for item in self.pointer(n).items()}
        dead = {item for n in gone for item in self.pointer(n).items()} - live
        for folder in [self._folder(p, n) for p, n in dead] + [f"{self.path}/pointer/version={n}" for n in gone]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket(key, buckets: int):
    """Part of a row by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, column: str = "bucket") -> list[int]:
    """Buckets that occur in ``rows``; there are no more than the table has."""
    return [r[0] for r in rows.select(column).distinct().collect()]
