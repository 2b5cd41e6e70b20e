"""Sharding with size-tiered compaction, in DataFrame functions only.

A store is a folder: `data/` has immutable runs of Parquet shards, `manifest/v=N.json` the schema and the live runs of
version N. Arrivals are appended as small runs. A run's tier is the logarithm of its size; when a tier has fan_in runs
or more they are merged, without a shuffle, into one run of target-sized files. Every change writes the next manifest
to a hidden file and moves it into place only where no file of that name is: by a hard link on a local or mounted file
system, elsewhere by a rename that does not overwrite, which is atomic on HDFS. Of two writers of a version one gets
it; an append then goes on top of the other's version, a compaction too if its runs are still live, else it is given
up. Object stores whose rename is a copy need a store folder on another file system.

Runs may differ in columns: the store's schema has all of them, by name without regard to case, and a run without a
column reads as nulls there. A column of two types is an error when it is appended, and nothing is committed then.
Nested fields are not merged: they have to be of one type.

Edge cases: an empty table appends no run but makes a version with its schema, so it reads back as no rows; a store
without a version reads as an error, as it has no schema; nulls, repeated rows, long texts and columns of any name
(arrival, run and tier too) are stored as they are.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_name

MANIFEST = "run string, tier int, files long, rows long, bytes long"
RUN = r"/(data/[^/]+(?:/arrival_*=[^/]+)?)/[^/]+$"


class VersionTaken(RuntimeError):
    """Another writer has committed this version first."""


def merged_schema(a: StructType, b: StructType) -> StructType:
    """The columns of both by name; ValueError if one has two types."""
    have = {f.name.lower(): f for f in a}
    for f in b:
        known = have.setdefault(f.name.lower(), f)
        if known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the store and {f.dataType.simpleString()} here")
    return StructType([StructField(f.name, f.dataType, True) for f in have.values()])


def _decoded_path() -> Column:
    """The path of a row's file as the file system names it; metadata gives it as a URI, where a plus stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20, growth: int = 4, fan_in: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.growth, self.fan_in = target_bytes, base_bytes, growth, fan_in

    # files: only names, sizes and manifests pass through the driver, never rows

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _names(self, folder: str) -> list:
        fs, path = self._fs(f"{self.root}/{folder}")
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._names("manifest")]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 for an empty store."""
        return max(self.versions(), default=0)

    def _load(self, version: int) -> tuple[StructType | None, list[dict]]:
        """The schema and the live runs of a version."""
        if not version:
            return None, []
        found = json.loads(self.spark.read.text(f"{self.root}/manifest/v={version}.json", wholetext=True).first()[0])
        return StructType.fromJson(found["schema"]), found["runs"]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live runs of a version: run, tier, files, rows, bytes. Tiers hold under fan_in runs each, so it is small."""
        runs = self._load(self.version() if version is None else version)[1]
        return self.spark.createDataFrame([tuple(r[c] for c in ("run", "tier", "files", "rows", "bytes")) for r in runs], MANIFEST)

    def commit(self, schema: StructType, runs: list[dict], version: int) -> None:
        """Makes these runs version, or raises VersionTaken."""
        fs, hidden = self._fs(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        target = self._fs(f"{self.root}/manifest/v={version}.json")[1]
        out = fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "runs": runs}).encode()))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":
                os.link(*(fs.makeQualified(p).toUri().getPath() for p in (hidden, target)))
            else:
                options = self.spark._jvm.org.apache.hadoop.fs.Options
                none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
                none[0] = getattr(options, "Rename").NONE
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, target, none)
        except FileExistsError:
            raise VersionTaken(f"version {version} of {self.root}") from None
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                raise VersionTaken(f"version {version} of {self.root}") from None
            raise
        finally:
            fs.delete(hidden, False)

    def _described(self, paths: list[str]) -> list[dict]:
        """The manifest rows of new runs, from their files."""
        files = self.spark.read.parquet(*paths).groupBy(_decoded_path().alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"))
        sums = files.groupBy(F.regexp_extract("file", RUN, 1).alias("run")).agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.sum("size").alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.base) / math.log(self.growth))).cast("int")
        return [r.asDict() for r in sums.select("run", tier.alias("tier"), "files", "rows", "bytes").orderBy("run").collect()]

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Adds the rows of df as new runs, one for each value of arrival, in one pass without a shuffle. The new version."""
        merged_schema(self._load(self.version())[0] or StructType(), df.schema)
        folder, name = f"data/{uuid.uuid4().hex}", free_name("arrival", df.columns, "_")
        rows = df.withColumn(name, arrival if arrival is not None else F.lit(0))
        rows.write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
        parts = [str(x.getPath()) for x in self._names(folder) if x.isDirectory()]
        new = self._described(parts) if parts else []
        while True:
            version = self.version()
            schema, live = self._load(version)
            try:
                self.commit(merged_schema(schema or StructType(), df.schema), live + new, version + 1)
                return version + 1
            except VersionTaken:  # appends don't exclude one another
                continue

    def compact(self) -> int:
        """Merges the runs of every tier that has fan_in or more, lowest tier first, until none has. The version then."""
        while True:
            version = self.version()
            schema, live = self._load(version)
            tiers: dict[int, list[dict]] = {}
            for r in live:
                tiers.setdefault(r["tier"], []).append(r)
            full = sorted(t for t, runs in tiers.items() if len(runs) >= self.fan_in)
            if not full:
                return version
            old = tiers[full[0]]
            folder, names = f"data/{uuid.uuid4().hex}", {r["run"] for r in old}
            size = max(1, math.ceil(sum(r["bytes"] for r in old) / self.target))
            self._rows(schema, old).coalesce(size).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            (new,) = self._described([f"{self.root}/{folder}"])
            # a merged run moves up at least one tier, or sparse ones would be merged again and again
            new["tier"] = max(new["tier"], full[0] + 1)
            while names <= {r["run"] for r in live}:
                try:
                    self.commit(schema, [r for r in live if r["run"] not in names] + [new], version + 1)
                    break
                except VersionTaken:  # still right on top of an append; given up if another compaction took the runs
                    version = self.version()
                    schema, live = self._load(version)

    def _rows(self, schema: StructType, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r['run']}" for r in runs))

    def read(self, version: int | None = None, run: str | None = None, tier: str | None = None) -> DataFrame:
        """All rows of a version, and the run and its tier in columns of these names if they are given."""
        schema, live = self._load(self.version() if version is None else version)
        if schema is None:
            raise ValueError("the store has no version yet")
        taken = {f.name.lower() for f in schema}
        for name in (run, tier):
            if name and name.lower() in taken:
                raise ValueError(f"the store has a column {name}")
        rows = self._rows(schema, live) if live else self.spark.createDataFrame([], schema)
        found = F.regexp_extract(_decoded_path(), RUN, 1) if live else F.lit(None).cast("string")
        key = run or free_name("run", schema.names)
        if run or tier:
            rows = rows.select("*", found.alias(key))
        if tier:  # runs are few: the manifest is small
            of = self.spark.createDataFrame([(r["run"], r["tier"]) for r in live], f"`{key}` string, `{tier}` int")
            rows = rows.join(F.broadcast(of), key)
        return rows.select(*schema.names, *(x for x in (run, tier) if x))

    def vacuum(self, keep: int = 1, older_than_seconds: float = 86_400) -> list[str]:
        """Removes all but the keep newest manifests, and runs that none of these has and that are older than so many seconds.

        Younger runs may be those of a writer that has not committed yet. Returns the removed paths.
        """
        kept = self.versions()[-keep:]
        live = {r["run"] for v in kept for r in self._load(v)[1]}
        folders = {r.split("/")[1] for r in live}
        before, gone = (time.time() - older_than_seconds) * 1000, []
        for x in self._names("manifest"):
            name = x.getPath().getName()
            if name.startswith("v=") and int(name[2:-5]) not in kept:
                gone.append(x.getPath())
        for x in self._names("data"):
            inner = [y for y in self._names(f"data/{x.getPath().getName()}") if y.isDirectory()]
            if x.getPath().getName() not in folders:
                if x.getModificationTime() <= before:
                    gone.append(x.getPath())
            else:
                gone += [y.getPath() for y in inner if f"data/{x.getPath().getName()}/{y.getPath().getName()}" not in live and y.getModificationTime() <= before]
        for path in gone:
            self._fs(self.root)[0].delete(path, True)
        return [str(p) for p in gone]
