"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder. ``append`` writes arrivals as small immutable shards, one for each task.
``compact`` merges shards of similar size (one tier: sizes within a factor) into files
of about the target size, and again as long as merging pays. Nothing is changed in place:
every step writes new files, then a new manifest, which names all live shards, and
commits it by renaming a draft to commits/<version>. Readers see the manifest
of the newest commit; of two writers that start from one version, the second fails and
leaves no trace in what readers see. That needs a store whose rename is atomic and refuses a taken name, as
HDFS's is. On object stores rename is a copy and on local disks the name is only looked up first: there, one writer at a time. A task or executor that is lost is repeated by
Spark, whose committer publishes whole files only.

    data/<step>/part-*.parquet        shards
    manifests/<version>-<step>/       a row a live shard: shard, step, n_bytes, n_rows, tier
    commits/<version>                 the manifest's folder name
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import filesystem, materialize, new_path, release, remove, sized

TARGET_BYTES = 64 << 20
FACTOR = 4
MIN_RUNS = 2
#: Shards that a lane of the planner takes, so that planning stays many small tasks for any number of shards.
LANE_SHARDS = 4096
#: Steps that no manifest names are kept so many seconds: a writer may be about to commit them.
RETENTION = 7 * 24 * 3600

MANIFEST = "shard string, step string, n_bytes long, n_rows long, tier int"


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, factor: int = FACTOR, min_runs: int = MIN_RUNS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.factor, self.min_runs = target_bytes, factor, min_runs

    def versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.root}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if not s.getPath().getName().startswith("_")) if fs.exists(at) else []

    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._name(version)}")

    def _name(self, version: int) -> str:
        """The manifest folder that a version's commit names."""
        fs, at = filesystem(self.spark, f"{self.root}/commits/{version:08}")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Publishes a manifest as version base+1, or raises CommitConflict and publishes nothing."""
        version, name = base + 1, f"{base + 1:08}-{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        fs, at = filesystem(self.spark, f"{self.root}/commits/{version:08}")
        draft_fs, draft = filesystem(self.spark, f"{self.root}/drafts/{name}")
        stream = draft_fs.create(draft, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(draft, at):  # a rename onto a name that is taken fails
            remove(self.spark, f"{self.root}/manifests/{name}")
            draft_fs.delete(draft, False)
            raise CommitConflict(f"version {version} is taken")
        return version

    def _tier(self, n_bytes):
        """0 for the smallest shards; one more for each factor in size. Shards near the target are in the last tier."""
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(n_bytes, F.lit(1)) / F.lit(float(self.target) / self.factor**8)) / F.log(F.lit(float(self.factor))))).cast("int")

    def _files(self, schema, names: list[str]) -> DataFrame:
        """All rows of the steps or shards, with a struct column that holds shard, n_bytes and row_index under a name of its own."""
        paths = [f"{self.root}/data/{s}" for s in names]
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        meta = files.metadataColumn("_metadata")
        of = F.struct(F.substring_index(meta["file_path"], "/data/", -1).alias("shard"), meta["file_size"].alias("n_bytes"), meta["row_index"].alias("row_index"))
        return files.select("*", of.alias(self._own(schema)))

    @staticmethod
    def _own(schema) -> str:
        name, taken = "quern_shard", {f.name.lower() for f in schema.fields}
        while any(t.startswith(name) for t in taken):  # names that begin with it are free as well
            name = "q" + name
        return name

    def _written(self, step: str, schema) -> DataFrame:
        """Manifest rows of a step's files: names and sizes as the store has them, row counts from the files."""
        own = self._own(schema)
        return self._files(schema, [step]).select(f"{own}.shard", f"{own}.n_bytes").groupBy("shard", "n_bytes").agg(F.count("*").alias("n_rows")).select(
            "shard", F.lit(step).alias("step"), "n_bytes", "n_rows", self._tier(F.col("n_bytes")).alias("tier")
        )

    def append(self, rows: DataFrame) -> int:
        """Writes arrivals as small shards and commits them; the version is the result."""
        base, step = self.version(), f"arrival-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{step}")
        return self.commit(self.manifest(base).unionByName(self._written(step, rows.schema)), base)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(shard, merge STRING) for the shards that should be merged; a merge is of one tier and about the target in size.

        Shards of three quarters of the target and more are done. The others of a tier are
        dealt to lanes, lined up, and cut where their running size passes a multiple of the target.
        """
        small = manifest.where(F.col("n_bytes") < 0.75 * self.target)
        lanes = small.groupBy("tier").agg(F.ceil(F.count("*") / LANE_SHARDS).alias("lanes"))
        dealt = small.join(F.broadcast(lanes), "tier").withColumn("lane", F.pmod(F.xxhash64("shard"), F.col("lanes")))  # a few tiers
        upto = Window.partitionBy("tier", "lane").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = dealt.withColumn("cut", F.floor((F.sum("n_bytes").over(upto) - F.col("n_bytes") / 2) / self.target))
        merge = cut.select("shard", "n_bytes", F.concat_ws("-", F.lit("t"), "tier", "lane", "cut").alias("merge"))
        runs = merge.groupBy("merge").agg(F.count("*").alias("runs")).where(F.col("runs") >= self.min_runs)
        return merge.join(runs, "merge").select("shard", "merge")

    def compact_once(self, schema) -> bool:
        """One round of merges and its commit; False if there is nothing to merge."""
        base = self.version()
        live = self.manifest(base)
        plan = materialize(self.plan(live), "plan")
        n, own = plan.count(), self._own(schema)
        if not n:
            release(plan)
            return False
        planned = [r["shard"] for r in plan.select("shard").collect()]  # names of files, which a reader lists in the driver anyway
        merge_numbers = plan.select("merge").distinct().withColumn("at", F.row_number().over(Window.orderBy("merge")) - 1)  # a row a file to write
        step, merges = f"merged-{uuid.uuid4().hex}", merge_numbers.count()
        numbered = plan.join(sized(merge_numbers, merges), "merge")
        rows = self._files(schema, planned).withColumn(own, F.col(f"{own}.shard"))
        taken = sized(numbered.select(F.col("shard").alias(f"{own}_"), F.col("at").alias(f"{own}__")), n)
        rows = rows.join(taken, F.col(own) == F.col(f"{own}_")).drop(own, f"{own}_")
        # a merge is one task of its own and one file
        rows.repartitionById(merges, F.col(f"{own}__")).write.option("compression", "zstd").partitionBy(f"{own}__").parquet(f"{self.root}/data/{step}")
        left = live.join(sized(plan.select("shard"), n), "shard", "left_anti")
        self.commit(left.unionByName(self._written(step, schema)), base)
        release(plan)
        return True

    def compact(self, schema) -> int:
        """Merges until nothing pays any more. A round leaves at most one shard short of the target in a tier and
        lane, so shards get fewer by each round and it ends. The version is the result."""
        while self.compact_once(schema):
            pass
        return self.version()

    def vacuum(self, retention: float = RETENTION) -> None:
        """Deletes steps of which the newest manifest has no shard, manifests that no commit names, and drafts, all older than ``retention`` seconds.

        Older versions can't be read then. A writer must commit within the retention; what others have written since stays.
        """
        live = {r["step"] for r in self.manifest().select("step").distinct().collect()}  # a row an append or merge
        named = {self._name(v) for v in self.versions()}
        for folder, kept in (("data", live), ("manifests", named), ("drafts", set())):
            fs, at = filesystem(self.spark, f"{self.root}/{folder}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                young = status.getModificationTime() > (time.time() - retention) * 1000
                if status.getPath().getName() not in kept and not young:
                    fs.delete(status.getPath(), True)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with a struct column (see ``_files``) that says where each lies."""
        live = self.manifest(version)
        steps = [r["step"] for r in live.select("step").distinct().collect()]
        own = self._own(schema)
        if not steps:
            return self.spark.createDataFrame([], schema).withColumn(own, F.lit(None).cast("struct<shard:string,n_bytes:bigint,row_index:bigint>"))
        n = live.count()
        return self._files(schema, steps).join(sized(live.select(F.col("shard").alias(f"{own}_")), n), F.col(f"{own}.shard") == F.col(f"{own}_"), "left_semi")


def shard(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, factor: int = FACTOR, min_runs: int = MIN_RUNS) -> ShardStore:
    """Appends docs to the store at root and compacts it. All columns of docs are kept, whatever their names.

    Nulls, empty and long texts and repeated rows are rows like others. An empty table
    commits a version without shards. A single row larger than the target is a shard. Merged arrivals stay
    until ``vacuum`` takes them.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, factor, min_runs)
    store.append(docs)
    store.compact(docs.schema)
    return store


def shard_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs, from the committed files: doc_id, shard, row_index, shard_bytes, version."""
    store = shard(docs, new_path(docs.sparkSession, "shards"))
    own = store._own(docs.schema)
    return store.read(docs.schema).select("doc_id", f"{own}.shard", f"{own}.row_index", F.col(f"{own}.n_bytes").alias("shard_bytes"), F.lit(store.version()).alias("version"))
