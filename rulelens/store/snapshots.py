"""Tables kept as versions.

Data files never change. A version is a manifest: a Parquet table with one row per data file and the smallest and largest
values of the clustering columns in it. Publishing a version creates one small pointer file, so that readers see all of a
change or nothing, and a run that fails midway leaves the version before as it was.

Folders below the table's path: ``data/<write>/`` files, ``manifests/<name>/``, ``changes/<name>/`` (what a version
changed), ``versions/<number>`` pointers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HASH, BLOCK = "_hash", "_block"
#: How values are written for the content hash: nulls kept, timestamps whole and independent of the session.
HASHED = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Rows of a block, the unit of the posting table; files hold many blocks.
BLOCK_ROWS = 64
#: A scope of so many distinct values at most is broadcast, so that a source with most of the rows is not one task's.
SCOPE_MOST = 500_000


def same_key(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of key columns."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def keyed(df: DataFrame, key: Sequence[str], *more: str) -> tuple[DataFrame, list[str]]:
    """The key columns of ``df`` under names of their own, for null-safe joins."""
    names = [f"_key_{k}" for k in key]
    return df.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), *more), names


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' values in the order of their names; nulls and empty values differ."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), HASHED), 256)


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """The ``rows`` whose values in the columns of ``scope`` stand there, nulls compared as equal; not shuffled by few values."""
    within, names = keyed(scope.distinct(), scope.columns)
    few = within.limit(SCOPE_MOST + 1).count() <= SCOPE_MOST
    return rows.join(F.broadcast(within) if few else within, same_key(scope.columns, names), "left_semi")


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    changes: str
    schema: StructType


@dataclass(frozen=True)
class SnapshotTable:
    """A versioned table of rows with a unique ``key``, clustered by ``cluster`` (ranges, sorted within files)."""

    spark: SparkSession
    path: str
    key: Sequence[str] = ("source", "id")
    cluster: Sequence[str] = ("source", "id")
    rows_per_file: int = 1_000_000
    block_rows: int = BLOCK_ROWS
    write_options: dict = field(default_factory=lambda: {"compression": "zstd"})

    # ------------------------------------------------------------ versions

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self, number: int | None = None) -> Version | None:
        """A version by number, or the newest; None where there is none. A pointer that was not finished does not count."""
        fs, folder = self._fs("versions")
        if not fs.exists(folder):
            return None
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
        for name in names:
            if not name.isdigit() or number not in (None, int(name)):
                continue
            stream = fs.open(self._fs(f"versions/{name}")[1])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                x = json.loads(text)
                return Version(int(name), x["manifest"], x["changes"], StructType.fromJson(x["schema"]))
        return None

    def publish(self, number: int, manifest: str, changes: str, schema: StructType) -> None:
        """Create the pointer of version ``number``; it fails if another writer was faster."""
        fs, path = self._fs(f"versions/{number:012d}")
        stream = fs.create(path, False)
        try:
            stream.write((json.dumps({"manifest": manifest, "changes": changes, "schema": schema.jsonValue()}) + "\n").encode())
        finally:
            stream.close()

    def files(self, version: Version | None = None) -> DataFrame:
        """The manifest: file (below data/), n_rows, and min_, max_ and nulls_ of each clustering column."""
        version = version or self.version()
        if version is None:
            raise ValueError(f"no version at {self.path}")
        return self.spark.read.parquet(f"{self.path}/manifests/{version.manifest}")

    def changes(self, version: Version | None = None) -> DataFrame:
        """Key columns, kind (insert, change, delete) of the rows that the version changed."""
        version = version or self.version()
        return self.spark.read.parquet(f"{self.path}/changes/{version.changes}").select(*self.key, "kind")

    # ------------------------------------------------------------ reading

    def _rows(self, names: Sequence[str], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def read(self, files: Column | None = None, version: Version | None = None) -> DataFrame:
        """The rows of all files, or of those whose manifest row fulfils ``files``; names come from the manifest alone.

        The list of files goes through the driver, as in any read of files.
        """
        version = version or self.version()
        listed = self.files(version)
        listed = listed if files is None else listed.where(files)
        return self._rows([r.file for r in listed.select("file").collect()], version.schema).drop(HASH, BLOCK)

    def where_in(self, column: str, values: Sequence) -> DataFrame:
        """Rows whose clustering ``column`` is one of the values: files by the manifest, row groups by their statistics."""
        c, low, high = F.col(column), F.col(f"min_{column}"), F.col(f"max_{column}")
        hit = reduce(lambda a, b: a | b, (F.lit(v).between(low, high) for v in values), F.lit(False))
        return self.read(hit).where(c.isin(*values))

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows clustered, in files that nothing refers to yet; their manifest rows."""
        folder = uuid.uuid4().hex
        order = [F.col(c).asc_nulls_first() for c in self.cluster]
        ranged = rows.drop(BLOCK).repartitionByRange(*order).sortWithinPartitions(*order)
        # the number of a row holds its partition in the upper bits, so that blocks of one write have different numbers
        ranged = ranged.withColumn(BLOCK, F.floor(F.monotonically_increasing_id() / F.lit(self.block_rows)).cast("long"))
        ranged.write.options(**self.write_options).option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.path}/data/{folder}")
        back = self.spark.read.schema(ranged.schema).parquet(f"{self.path}/data/{folder}")
        name = F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file")
        stats = [f(c).alias(f"{n}_{c}") for c in self.cluster for n, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
        return back.groupBy(name).agg(F.count("*").alias("n_rows"), *stats)

    def _publish_manifest(self, rows: DataFrame, number: int, changes: str, schema: StructType) -> Version:
        name = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        self.publish(number, name, changes, schema)
        return Version(number, name, changes, schema)

    def apply(self, batch: DataFrame, scope: DataFrame | None = None) -> Version | None:
        """Bring ``batch`` (one row per key) into the table as a new version; None where it changes nothing.

        Rows are new, changed (their content hash differs) or the same. ``scope`` states for which values of its columns
        the batch is complete: rows of the table in the scope that the batch lacks are deleted, all of them where the
        batch has none. Without it nothing is deleted. Keys and scopes compare nulls as equal. A batch that is applied
        again changes nothing. Only files that hold changed or deleted rows are written anew.
        """
        old = self.version()
        new = batch.withColumn(HASH, content_hash(batch.columns))
        mine, names = keyed(new, self.key, F.col(HASH).alias("_new"))
        log = uuid.uuid4().hex
        if old is None:
            found = new.select(*self.key, F.lit("insert").alias("kind"), F.lit(None).cast("string").alias("file"))
        else:
            # the key, the hash and the file are all that is read of the table here
            names_now = [r.file for r in self.files(old).select("file").collect()]
            at = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1) if names_now else F.lit(None).cast("string")
            have = self._rows(names_now, old.schema).select(*self.key, HASH, at.alias("file"))
            met = have.join(mine, same_key(self.key, names))
            changed = met.where(F.col(HASH) != F.col("_new")).select(*self.key, F.lit("change").alias("kind"), "file")
            there, there_names = keyed(met.select(*self.key), self.key)
            added = new.join(there, same_key(self.key, there_names), "left_anti").select(*self.key, F.lit("insert").alias("kind"), F.lit(None).cast("string").alias("file"))
            found = changed.unionByName(added)
            if scope is not None:
                gone = in_scope(have, scope).join(mine, same_key(self.key, names), "left_anti")
                found = found.unionByName(gone.select(*self.key, F.lit("delete").alias("kind"), "file"))
        found.write.parquet(f"{self.path}/changes/{log}")
        found = self.spark.read.schema(found.schema).parquet(f"{self.path}/changes/{log}")
        if found.head() is None and old is not None:
            return None

        arrived, a_names = keyed(found.where("kind <> 'delete'"), self.key)
        rows = new.join(arrived, same_key(self.key, a_names), "left_semi") if old is not None else new
        manifest = None
        if old is not None:
            touched = found.where("file is not null").select("file").distinct()
            gone, g_names = keyed(found.where("kind <> 'insert'"), self.key)
            kept = self._rows([r.file for r in touched.collect()], old.schema).join(gone, same_key(self.key, g_names), "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
            manifest = self.files(old).join(touched, "file", "left_anti")
        schema = StructType([f for f in rows.schema if f.name != BLOCK]).add(BLOCK, "long")
        written = self._write(rows)
        listed = written if manifest is None else manifest.unionByName(written)
        return self._publish_manifest(listed, 0 if old is None else old.number + 1, log, schema)

    def compact(self, least_rows: int) -> Version | None:
        """Rewrite the files of fewer than ``least_rows`` rows together, as a version that changes no row."""
        old = self.version()
        small = self.files(old).where(F.col("n_rows") < least_rows)
        names = [r.file for r in small.select("file").collect()]
        if len(names) < 2:
            return None
        written = self._write(self._rows(names, old.schema))
        log = uuid.uuid4().hex
        self.changes(old).withColumn("file", F.lit(None).cast("string")).limit(0).write.parquet(f"{self.path}/changes/{log}")
        return self._publish_manifest(self.files(old).join(small.select("file"), "file", "left_anti").unionByName(written), old.number + 1, log, old.schema)

    def changes_since(self, number: int) -> DataFrame | None:
        """Distinct keys that versions after ``number`` touched: what a table derived from this one must bring up to date.

        None where a version in between has expired, so that the derived table must be made anew.
        """
        last = self.version()
        between = [self.version(n) for n in range(number + 1, last.number + 1)]
        if None in between:
            return None
        if not between:
            return self.changes(last).select(*self.key).limit(0)
        return self.spark.read.parquet(*(f"{self.path}/changes/{v.changes}" for v in between)).select(*self.key).distinct()

    def expire(self, keep: int) -> int:
        """Delete all but the newest ``keep`` versions, and the data files that only those refer to; how many files went.

        Files of a write that is under way belong to no version and stay. Pointers go first: what a failure leaves behind
        is unused.
        """
        if keep < 1:
            raise ValueError("at least one version must stay")
        last = self.version()
        old = [v for n in range(max(0, last.number - keep + 1)) if (v := self.version(n))]
        kept = [v for n in range(max(0, last.number - keep + 1), last.number + 1) if (v := self.version(n))]
        if not old:
            return 0
        listed = lambda versions: self.spark.read.parquet(*(f"{self.path}/manifests/{v.manifest}" for v in versions)).select("file").distinct()
        gone = [r.file for r in listed(old).join(listed(kept), "file", "left_anti").collect()]
        fs, _ = self._fs("")
        names = [f"versions/{v.number:012d}" for v in old] + [f"{d}/{x}" for v in old for d, x in (("manifests", v.manifest), ("changes", v.changes))]
        for name in names + [f"data/{n}" for n in gone]:
            fs.delete(self._fs(name)[1], True)
        return len(gone)
