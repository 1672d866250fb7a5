"""Tables with upsert on Parquet: a version is a manifest of files that versions share.

Rows lie in files by the hash of their key (``buckets``), sorted, and a manifest lists each file with its bucket, its number of rows and its least and
greatest key. A write adds files: the batch's rows, and the places (file, row) of the rows that they replace, found in those files alone whose bucket and
range meet the batch's, by their key column. So bytes written follow the batch, not the table; ``compact`` rewrites buckets of many files
or deletions. Versions differ by their manifests, from which ``changes`` finds what to read; ``expire`` drops versions, and files that no other version lists.

A writer adds its manifest and then moves the pointer, so a reader sees one whole version and a failed write changes nothing. Of two writers at a
time the later fails and has to try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from shotloom.schemas import FILMS_TABLE, UNITS, conform

#: kind: data (a file), deleted (rows of ``file`` whose places are in the folder ``low``) or batch (the last batch of a stream).
MANIFEST = "kind string, file string, bucket int, n long, low string, high string"


def _place() -> Column:
    """A row's file, below the folder of files."""
    return F.regexp_extract("_metadata.file_path", ".*/files/(.*)$", 1)


class Table:
    """One table below the store's root; ``key`` identifies rows. ``buckets`` holds from its creation on."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, key: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self._buckets = spark, f"{root.rstrip('/')}/{name}", schema, key, buckets

    # --- files, versions, the pointer ---

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        folder = path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def versions(self) -> list[int]:
        fs, path = self._fs()
        return sorted(int(n[1:]) for n in self._names("manifests") if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.path}/manifests/{n}/_SUCCESS")))

    def _moves(self) -> list[int]:
        return sorted(int(n) for n in self._names("pointers") if n.isdigit())

    def _pointer(self) -> tuple[int, int | None]:
        """The newest move, and the version that the newest complete one names; an empty file is a writer's that failed."""
        fs, path = self._fs()
        moves = self._moves()
        for move in reversed(moves):
            stream = fs.open(path(f"{self.path}/pointers/{move}"))
            found = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if found:
                return moves[-1], int(found)
        return max([-1, *moves]), None

    def current(self) -> int | None:
        """The version that the newest pointer names."""
        return self._pointer()[1]

    def point(self, version: int, after: int | None = None) -> None:
        """Make a version the current one by the move that follows ``after``, the one that it was based on; only one writer can make it."""
        fs, path = self._fs()
        move = 1 + (max([-1, *self._moves()]) if after is None else after)
        try:
            stream = fs.create(path(f"{self.path}/pointers/{move}"), False)
        except Exception as e:
            raise RuntimeError("another writer moved the pointer") from e
        stream.writeBytes(str(version))
        stream.close()

    def rollback(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self.point(version)

    @property
    def buckets(self) -> int:
        named = [int(n[8:]) for n in self._names("settings") if n.startswith("buckets-")]
        return named[0] if named else self._buckets

    def create(self) -> Table:
        """The empty first version, unless the table exists."""
        if self.current() is None:
            fs, path = self._fs()
            fs.mkdirs(path(f"{self.path}/settings"))
            fs.createNewFile(path(f"{self.path}/settings/buckets-{self._buckets}"))
            self._commit(self.spark.createDataFrame([], MANIFEST), -1)
        return self

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{version}")

    def _commit(self, manifest: DataFrame, after: int) -> int:
        version = 1 + max([-1, *self.versions()])
        manifest.write.mode("error").parquet(f"{self.path}/manifests/v{version}")
        self.point(version, after)
        return version

    # --- reading ---

    def _rows(self, manifest: DataFrame, columns: list[str]) -> DataFrame:
        """Live rows of a manifest's files, with _file and _row. Only files with deletions are joined with those."""
        listed = manifest.where("kind <> 'batch'").select("kind", "file", "low").collect()  # a row a file
        gone = {r["file"] for r in listed if r["kind"] == "deleted"}
        folders = sorted({r["low"] for r in listed if r["kind"] == "deleted"})
        schema = StructType([f for f in self.schema.fields if f.name in columns])
        parts = []
        for touched in (False, True):
            files = sorted(f"{self.path}/files/{r['file']}" for r in listed if r["kind"] == "data" and (r["file"] in gone) == touched)
            if files:
                df = self.spark.read.schema(schema).parquet(*files).select(*columns, _place().alias("_file"), F.col("_metadata.row_index").alias("_row"))
                parts.append(df.join(self.spark.read.parquet(*(f"{self.path}/deleted/{x}" for x in folders)), ["_file", "_row"], "left_anti").select(*columns, "_file", "_row") if touched else df)
        if not parts:
            return self.spark.createDataFrame([], schema).select(*columns, F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version), self.schema.names).select(self.schema.names)

    def lookup(self, value, version: int | None = None) -> DataFrame:
        """The row with this key, from the files whose bucket and range have room for it; the filter reaches their scan."""
        manifest, name = self.manifest(version), F.lit(value).cast(self.schema[self.key].dataType)
        fits = manifest.where((F.col("kind") == "data") & (F.col("bucket") == self._bucket(name)) & (F.col("low") <= name.cast("string")) & (F.col("high") >= name.cast("string")))
        mine = manifest.join(fits.select("file"), "file", "left_semi")
        return self._rows(mine, self.schema.names).select(self.schema.names).where(F.col(self.key) == F.lit(value)).limit(1)

    def count(self, version: int | None = None) -> int:
        """From the manifest alone."""
        return self.manifest(version).agg(F.sum(F.when(F.col("kind") == "data", F.col("n")).when(F.col("kind") == "deleted", -F.col("n")))).first()[0] or 0

    # --- writing ---

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _add(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write rows as new files: their folder, and their part of the manifest."""
        name = uuid.uuid4().hex
        path = f"{self.path}/files/{name}"
        rows.withColumn("_bucket", self._bucket(F.col(self.key))).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(path)
        key = F.col(self.key).cast("string")
        if not any(n.startswith("_bucket=") for n in self._names(f"files/{name}")):
            return path, self.spark.createDataFrame([], MANIFEST)
        stored = self.spark.read.schema(StructType([self.schema[self.key]]).add("_bucket", IntegerType())).parquet(path)
        listed = stored.groupBy(_place().alias("file"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        return path, listed.select(F.lit("data").alias("kind"), "file", "bucket", "n", "low", "high")

    def _stored(self, path: str, column: str) -> DataFrame:
        """A column of what was just written."""
        return self.spark.read.schema(StructType([self.schema[column]])).parquet(path)

    def _delete(self, victims: DataFrame) -> DataFrame:
        """Write the places (_file, _row): their part of the manifest."""
        name = uuid.uuid4().hex
        victims.select("_file", "_row").write.parquet(f"{self.path}/deleted/{name}")
        found = self.spark.read.schema("_file string, _row long").parquet(f"{self.path}/deleted/{name}").groupBy("_file").agg(F.count("*").alias("n"))
        return found.select(F.lit("deleted").alias("kind"), F.col("_file").alias("file"), F.lit(None).cast("int").alias("bucket"), "n", F.lit(name).alias("low"), F.lit(None).cast("string").alias("high"))

    def _base(self) -> tuple[DataFrame, int]:
        """The current manifest and the newest move."""
        move, version = self._pointer()
        return self.manifest(version) if version is not None else self.spark.createDataFrame([], MANIFEST), move

    def _met(self, manifest: DataFrame, listed: DataFrame) -> DataFrame:
        """The part of the manifest whose files may hold a key of the listed files."""
        batch = listed.groupBy("bucket").agg(F.min("low").alias("least"), F.max("high").alias("most"))
        fits = manifest.where("kind = 'data'").join(batch, "bucket").where("low <= most and high >= least").select("file")
        return manifest.join(fits, "file", "left_semi")

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows replace those with their key and add the others; of several with one key the last by ``order`` counts, and without an order
        that is an error. A ``batch`` (a stream's name and number) that the table has already seen changes nothing."""
        manifest, after = self._base()
        if batch and not manifest.where((F.col("kind") == "batch") & (F.col("file") == batch[0]) & (F.col("n") >= batch[1])).isEmpty():
            return self.current()
        path, listed = self._add(conform(last_by_key(rows, self.key, order) if order else unique(rows, self.key), self.schema))
        met = self._rows(self._met(manifest, listed), [self.key])
        gone = self._delete(met.join(self._stored(path, self.key), self.key, "left_semi"))
        return self._commit(self._with_batch(manifest, batch).unionByName(listed).unionByName(gone), after)

    def _with_batch(self, manifest: DataFrame, batch: tuple[str, int] | None) -> DataFrame:
        if not batch:
            return manifest
        seen = self.spark.createDataFrame([("batch", batch[0], None, batch[1], None, None)], MANIFEST)
        return manifest.where((F.col("kind") != "batch") | (F.col("file") != batch[0])).unionByName(seen)

    def replace(self, rows: DataFrame, by: str, batch: tuple[str, int] | None = None) -> int:
        """All rows whose ``by`` or key occurs in the new ones are replaced: nothing stale stays behind. Reads the ``by`` of all files."""
        manifest, after = self._base()
        if batch and not manifest.where((F.col("kind") == "batch") & (F.col("file") == batch[0]) & (F.col("n") >= batch[1])).isEmpty():
            return self.current()
        path, listed = self._add(conform(unique(rows, self.key), self.schema))
        victims = self._rows(manifest, [by]).join(self._stored(path, by).distinct(), by, "left_semi").select("_file", "_row")
        same = self._rows(self._met(manifest, listed), [self.key]).join(self._stored(path, self.key), self.key, "left_semi").select("_file", "_row")
        gone = self._delete(victims.union(same).distinct())
        return self._commit(self._with_batch(manifest, batch).unionByName(listed).unionByName(gone), after)

    def remove(self, keys: DataFrame) -> int:
        """Delete the rows with these keys."""
        manifest, after = self._base()
        some = keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key))
        name = F.col(self.key).cast("string")
        listed = some.groupBy(self._bucket(F.col(self.key)).alias("bucket")).agg(F.min(name).alias("low"), F.max(name).alias("high"))
        gone = self._delete(self._rows(self._met(manifest, listed), [self.key]).join(some, self.key, "left_semi"))
        return self._commit(manifest.unionByName(gone), after)

    def compact(self, files: int = 8, share: float = 0.2) -> int | None:
        """Rewrite the buckets that have more than so many files, or more than that share of deleted rows. None if there are none."""
        manifest, after = self._base()
        lost = manifest.where("kind = 'deleted'").groupBy("file").agg(F.sum("n").alias("lost"))
        state = manifest.where("kind = 'data'").join(lost, "file", "left").groupBy("bucket").agg(F.count("*").alias("files"), (F.sum("lost") / F.sum("n")).alias("share"))
        full = state.where((F.col("files") > files) | (F.col("share") > share)).select("bucket")
        if full.isEmpty():
            return None
        old = manifest.where("kind = 'data'").join(full, "bucket", "left_semi").select("file")
        _, listed = self._add(self._rows(manifest.join(old, "file", "left_semi"), self.schema.names).select(self.schema.names))
        return self._commit(manifest.join(old, "file", "left_anti").select(manifest.columns).unionByName(listed), after)

    # --- versions ---

    def changes(self, old: int, new: int) -> DataFrame:
        """(key, change, before, after) for the rows that were added, changed or removed between two versions; only files in which they differ are read."""
        a, b = self.manifest(old).where("kind <> 'batch'"), self.manifest(new).where("kind <> 'batch'")
        entry = ["kind", "file", F.coalesce("low", F.lit("")).alias("low")]
        x, y = a.select(*entry), b.select(*entry)
        differ = x.exceptAll(y).unionByName(y.exceptAll(x)).select("file").distinct()
        row = F.struct(*self.schema.names)
        before, after = (self._rows(m.join(differ, "file", "left_semi"), self.schema.names).select(F.col(self.key), row.alias(name)) for m, name in ((a, "before"), (b, "after")))
        both = before.join(after, self.key, "full")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(self.key, change.alias("change"), "before", "after")

    def expire(self, keep: int = 5) -> list[int]:
        """Drop all but the newest versions and the current one, with the files that none of those lists; returns the dropped ones."""
        versions = self.versions()
        kept = {*versions[-keep:], self.current()}
        dropped = [v for v in versions if v not in kept]
        fs, path = self._fs()
        place = F.when(F.col("kind") == "data", F.concat(F.lit("files/"), "file")).otherwise(F.concat(F.lit("deleted/"), "low")).alias("place")

        def places(some) -> DataFrame:
            return self.spark.read.schema(MANIFEST).parquet(*(f"{self.path}/manifests/v{v}" for v in some)).where("kind <> 'batch'").select(place).distinct()

        if dropped:
            free = places(dropped).join(places(kept), "place", "left_anti").collect()  # a row a file
            for v in dropped:  # first, so that no version lists a missing file
                fs.delete(path(f"{self.path}/manifests/v{v}"), True)
            for r in free:
                fs.delete(path(f"{self.path}/{r['place']}"), True)
        return dropped


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; of equal ones that whose columns, written as JSON, come last."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; a key that several have is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit(f"no order to tell which row counts, {key}: "), F.col(key).cast("string"))).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update all, insert all."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


class Store:
    """The units and films tables below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.units = Table(spark, root, "units", UNITS, "unit_id")
        self.films = Table(spark, root, "films", FILMS_TABLE, "film_id")

    def create(self) -> Store:
        self.units.create()
        self.films.create()
        return self
