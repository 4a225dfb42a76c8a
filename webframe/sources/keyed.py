"""Tables that grow by numbered batches, and of which a batch reads only what concerns it.

A table is a folder of runs `run=<first>-<last>`, each with the rows of so many batches, sorted by bucket and key. A batch is
written as a run of its own, and runs of like size are merged before the next is written, so after n batches there are at
most about log2(n) runs, and a row is rewritten as often. A run counts once it is complete, and a complete run stands for all that lie
within it. So a batch that broke off, or a merge, is simply done again, and what a committed batch wrote is not written twice.

Rows of a `KeyedTable` lie in folders by a hash of their key. Who asks for some keys opens the folders of these keys' buckets and no
others. Of the rows of a key the latest counts; a row marked `gone` takes its key out of the table, and leaves it when
runs are merged from the first one on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.session import remove_folder

BUCKETS = 64


class RunTable:
    """A table of runs without a key, such as a log."""

    #: Further columns that are kept as folders' names.
    folders = ""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def create(self) -> None:
        """Make the table's folder, so that a table without runs is told from one that is not there."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def opened(self):
        """The table, whose folder must be there."""
        if not self._exists():
            raise FileNotFoundError(self.path)
        return self

    def _complete(self) -> list[tuple[int, int]]:
        """Complete runs, also those that another one stands for."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        marked = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"run=(\d+)-(\d+)", n))]
        return sorted(r for r in found if fs.exists(marked(f"{self._at(*r)}/_SUCCESS")))

    def runs(self) -> list[tuple[int, int]]:
        """The runs that make up the table, oldest first."""
        out: list[tuple[int, int]] = []
        for first, last in sorted(self._complete(), key=lambda r: (r[0], -r[1])):
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def last(self) -> int | None:
        """The number of the last batch, None where there is none."""
        runs = self.runs()
        return runs[-1][1] if runs else None

    def _at(self, first: int, last: int) -> str:
        return f"{self.path}/run={first}-{last}"

    def _load(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema + self.folders)
        reader = self.spark.read.schema(f"{self.schema}, run string{self.folders}").option("basePath", self.path)
        return reader.parquet(*[self._at(*r) for r in runs]).drop("run")

    def _reduced(self, rows: DataFrame, oldest: bool) -> DataFrame:
        return rows

    def _save(self, rows: DataFrame, first: int, last: int) -> None:
        rows.hint("rebalance").write.mode("overwrite").parquet(self._at(first, last))

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows, or those of the batches up to a number that no merge has passed."""
        return self._load([r for r in self.runs() if upto is None or r[1] <= upto])

    def append(self, rows: DataFrame, number: int) -> None:
        """Write batch `number`, again if its run is there but no later one; earlier batches must be settled.

        Runs that are merged are deleted, so frames read before must not be used after."""
        if any(first <= number <= last and first < last or last > number for first, last in self.runs()):
            return
        self._merge(number)
        self._save(rows, number, number)

    def _merge(self, number: int) -> None:
        settled = [r for r in self.runs() if r[1] < number]
        start, width = len(settled), 0
        # like carrying in a binary count: runs no wider than all after them together
        while start and (width == 0 or settled[start - 1][1] - settled[start - 1][0] < width):
            start -= 1
            width += settled[start][1] - settled[start][0] + 1
        chosen = settled[start:]
        if len(chosen) > 1:
            self._save(self._reduced(self._load(chosen), start == 0), chosen[0][0], chosen[-1][1])
        standing = self.runs()
        for first, last in self._complete():
            if (first, last) not in standing:
                remove_folder(self.spark, self._at(first, last))


class MergedTable(RunTable):
    """A table of runs whose rows merge: one row per values of `by` in each run, and in all when read.

    `merges` has the native aggregate of every other column (sums by default), so that merging may happen in any order."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], merges: dict[str, str] | None = None):
        super().__init__(spark, path, schema)
        self.by, self.fields = by, spark.createDataFrame([], schema).schema
        self.merges = merges or {}

    def _reduced(self, rows: DataFrame, oldest: bool = True) -> DataFrame:
        others = [f for f in self.fields if f.name not in self.by]
        merged = [F.expr(f"{self.merges.get(f.name, 'sum')}({f.name})").cast(f.dataType).alias(f.name) for f in others]
        return rows.groupBy(*self.by).agg(*merged).select(*self.fields.names)

    def read(self, upto: int | None = None) -> DataFrame:
        return self._reduced(super().read(upto))


class KeyedTable(RunTable):
    """A table of runs by `key`. Besides its key a row may have other columns; `gone` and `number` are the table's own.

    `buckets` stays the same for the life of a table: as many as bring a bucket of its final size to what one task
    sorts well."""

    folders = ", bucket int"

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url", buckets: int = BUCKETS):
        super().__init__(spark, path, f"{schema}, gone boolean, number int")
        self.key, self.buckets = key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _reduced(self, rows: DataFrame, oldest: bool) -> DataFrame:
        """One row per key and merged run."""
        others = [c for c in rows.columns if c != self.key]
        row = F.max_by(F.struct(*others), "number").alias("_row")
        out = rows.groupBy(self.key).agg(row).select(self.key, "_row.*").select(*rows.columns)
        return out.filter("NOT gone") if oldest else out

    def _save(self, rows: DataFrame, first: int, last: int) -> None:
        keyed = rows.withColumn("bucket", self._bucket(F.col(self.key))).hint("rebalance", "bucket")
        keyed.sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(self._at(first, last))

    def _of(self, keys: DataFrame | None, upto: int | None) -> DataFrame:
        rows = self.read_runs(upto)
        if keys is None:
            return rows
        # at most one number per bucket
        chosen = [r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect()]
        return rows.filter(F.col("bucket").isin(chosen))

    def read_runs(self, upto: int | None = None) -> DataFrame:
        """All rows of all runs, replaced ones too."""
        return super().read(upto)

    def read(self, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """The latest row of each key, without those that are gone; with `keys`, of all keys in the buckets of these."""
        return self._reduced(self._of(keys, upto), oldest=True).select(*self.columns)

    def keys(self, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """Keys of a table from which none ever goes, repeated if they were appended repeatedly: read without a shuffle."""
        return self._of(keys, upto).select(self.key)

    def append(self, rows: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Write batch `number`: rows with the table's columns, one per key, and the keys that go."""
        new = rows.select(*self.columns).withColumn("gone", F.lit(False))
        if gone is not None:
            new = new.unionByName(gone.select(self.key).withColumn("gone", F.lit(True)), allowMissingColumns=True)
        super().append(new.withColumn("number", F.lit(number)), number)
