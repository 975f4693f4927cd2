"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "leafwise") -> SparkSession:
    """A session tuned for the operators in this package.

    On a cluster, ``master`` stays None so spark-submit decides; locally the caller passes ``local[N]``.  The
    number of shuffle partitions is the cluster's unless the caller passes one.  The UI is off (no server is
    opened).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("LEAFWISE_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    tune(spark)
    return spark


#: HotSpot never compiles a method of more bytes than this; it would run interpreted at any input size.
JIT_METHOD_BYTES = 8000


def tune(spark: SparkSession) -> None:
    """Let Spark take stages whose generated method the JIT would refuse apart into expression by expression
    projections, unless the application has set the limit itself."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535" and not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(JIT_METHOD_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names that folder.  Only a local master may do without: it gets a private scratch folder, as
    driver and executors share one machine there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="leafwise-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet below the checkpoint folder and read back: cuts the lineage like
    ``cut_lineage`` for a fraction of the disk, where the partitions need not stay as they are.  VARIANTs are written
    whole: columns that Spark infers for their parts would turn 5 into 5.0 where other rows hold fractions."""
    path = scratch_dir(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    with setting(df.sparkSession, "spark.sql.variant.inferShreddingSchema", "false"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed here, once a row, without moving a row: later expressions read them as values.
    Otherwise Spark puts a struct column's expressions in place of every access to its fields."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def small_side(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, stored, with a broadcast hint if its rows take at most ``most_bytes`` as JSON text (measured).

    For dimension tables joined on keys that most rows share: a shuffle by such a key would put them in one task.
    A larger table is joined as it is; its keys are then many."""
    kept = cut_lineage(df)
    size = kept.agg(F.sum(F.length(F.to_json(F.struct(*kept.columns))))).first()[0] or 0
    return F.broadcast(kept) if size <= most_bytes else kept


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for derived files a job writes."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextlib.contextmanager
def open_writers(spark: SparkSession, most: int = 64) -> Iterator[None]:
    """Writes by partition columns inside keep a file open per value instead of sorting all rows by them first; a task
    that meets more than ``most`` values sorts the rest."""
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(most)):
        yield


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written below the checkpoint folder.  Call it when the results that
    were derived from it are stored elsewhere."""
    base = spark.sparkContext.getCheckpointDir()
    if base:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to ``spark.leafwise.spread`` partitions ahead of a CPU-heavy stage.

    Unset, this is a round of local-mode help: the test tables are single row groups, which one task reads, so a
    local master gets two partitions per core.  On a cluster the input's own splits are kept and nothing is
    shuffled.  The plan is never run to find out."""
    sc = df.sparkSession.sparkContext
    local = 2 * sc.defaultParallelism if sc.master.startswith("local[") else 0
    target = int(sc.getConf().get("spark.leafwise.spread", str(local)))
    return df.repartition(target, *keys) if target > 0 else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a narrow table scan to four partitions per core on any master (two on a local one, or what
    ``spark.leafwise.spread`` asks for; 0: not at all).

    A file's row groups limit how many tasks can read it, and narrow work after the scan would stay in those tasks;
    the scan's few columns are cheap to shuffle."""
    sc = df.sparkSession.sparkContext
    per_core = 2 if sc.master.startswith("local[") else 4
    target = int(sc.getConf().get("spark.leafwise.spread", str(per_core * sc.defaultParallelism)))
    return df.repartition(target) if target > 0 else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``leafwise`` importable by Python workers (the assignment kernel UDF is
    pickled by module reference): zip the package once per SparkContext and hand it
    to ``addPyFile``, which distributes it to every executor."""
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="leafwise-pkg-")
    archive = shutil.make_archive(os.path.join(base, "leafwise"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
