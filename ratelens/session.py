"""Session helpers.

The library never builds a session inside an operator: every function takes the
caller's ``SparkSession`` (from ``spark-submit`` or the test fixture).  The
helpers here only (a) build a local session for tests/bench/CLI and (b) resolve
shared folders (checkpoints, models) from the session's own settings.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# SQL settings every plan in this package assumes.  They are session-scoped and
# safe to set on an existing cluster session.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def scale_settings(input_bytes: int, partition_bytes: int = 256 << 20,
                   min_partitions: int = 200, max_partitions: int = 200_000) -> dict[str, str]:
    """SQL settings sized to the input volume (e.g. 100 TB -> ~400 000 map
    splits of 256 MB, shuffle partitions capped at 200 000 and coalesced by AQE
    to ~128 MB).  Skewed partitions (5x the median and > 256 MB) are split."""
    shuffle = max(min_partitions, min(max_partitions, input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int) -> SparkSession:
    for key, value in scale_settings(input_bytes).items():
        spark.conf.set(key, value)
    return spark


def cluster_session(app_name: str = "ratelens") -> SparkSession:
    """The session of the submitted application: its master and settings are kept;
    only the SQL defaults of this package are added."""
    return apply_sql_defaults(SparkSession.builder.appName(app_name).getOrCreate())


def input_bytes(spark: SparkSession, *paths: str) -> int:
    return sum(size for _, size, _ in table_stamp(spark, *paths))


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "ratelens", extra: dict | None = None) -> SparkSession:
    """A local session for tests, the bench and the CLI (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SQL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def table_stamp(spark: SparkSession, *paths: str) -> tuple:
    """(path, length, modification time) of every file of the tables: results kept
    for a table are only valid for the same stamp."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        files = hpath.getFileSystem(conf).listFiles(hpath, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading it from the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS/S3/...);
    it is never invented here.  Only a local session without the setting (tests)
    gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if configured.startswith("file:") and not _is_local(spark) and not sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is a file: folder: executors of a cluster do not share it")
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative jobs need a shared folder "
            "(e.g. hdfs:///tmp/checkpoints) to cut lineage and survive executor loss")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ratelens-ckpt-"))
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for other shared state (models,
    streaming checkpoints, spilled intermediate tables)."""
    # Spark adds a folder per application: what lies in it belongs to this run
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ratelens/{name}"


def lasting_dir(spark: SparkSession, name: str) -> str:
    """A folder that later applications find again (stream checkpoints, saved
    models): beside the per-application folder, below the configured one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/').rsplit('/', 1)[0]}/ratelens/{name}"


def clean_run(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables (rounds, results, previews).
    Call it when the results have been consumed or written elsewhere."""
    delete_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ratelens")


class RoundStore:
    """Per-run folder of intermediate tables under the shared checkpoint folder.

    ``put`` writes a round's table as parquet and returns a fresh scan of it:
    lineage is cut (no replay of earlier rounds after an executor loss) and the
    next round plans against file statistics.  Older rounds are deleted as soon
    as a newer one is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        import uuid
        self.spark = spark
        self.root = shared_dir(spark, f"rounds/{name}-{uuid.uuid4().hex}")
        self._written: dict[str, list[str]] = {}
        self._tables: dict[str, str] = {}  # path -> catalog name of a bucketed table
        self._seq = 0

    def put(self, df, tag: str, keep: int = 2):
        self._seq += 1
        path = f"{self.root}/{tag}/{self._seq}"
        self._written.setdefault(tag, [])
        df.write.mode("overwrite").parquet(path)
        self._written[tag].append(path)
        while len(self._written[tag]) > keep:
            self._delete(self._written[tag].pop(0))
        return self.spark.read.parquet(path)

    def put_bucketed(self, df, tag: str, column: str, buckets: int, keep: int = 2):
        """As ``put``, in ``buckets`` hash buckets of ``column``: joins on it that shuffle
        their other side into as many partitions do not shuffle this table.  The
        rows should come hash-partitioned by ``column``, else a bucket has several files."""
        self._seq += 1
        path = f"{self.root}/{tag}/{self._seq}"
        name = f"ratelens_{self.root.rsplit('-', 1)[-1]}_{tag}_{self._seq}".replace("-", "_")
        df.write.mode("overwrite").bucketBy(buckets, column).format("parquet").option("path", path).saveAsTable(name)
        self._tables[path] = name
        self._written.setdefault(tag, []).append(path)
        while len(self._written[tag]) > keep:
            self._delete(self._written[tag].pop(0))
        return self.spark.table(name)

    def _delete(self, path: str) -> None:
        if path in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(path)}")
        delete_path(self.spark, path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            for path in self._written.pop(tag, []):
                self._delete(path)

    def close(self) -> None:
        self.drop(*list(self._written))
        delete_path(self.spark, self.root)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem, so it works for any scheme."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(hpath).isFile()
