"""What the text operators share: staging, size-checked joins, ranks within groups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast. Wider rows need a lower figure.
BROADCAST_ROWS = 200_000

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for staged tables.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder; on a cluster that is an error, for executors could not read it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own_dir:
            _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        base = _own_dir[sc.applicationId]
    return f"{base.rstrip('/')}/tessera-{sc.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: its folder stays for whoever keeps the store tidy
        pass


_registered: set[str] = set()


#: Bytes of a batch between the JVM and Python: texts may be long, and a worker holds a few.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES for the session, unless another limit than Spark's own is set."""
    if spark.conf.get(_BATCH) in ("67108864b", "67108864"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Rows of a staged file where a bound of the rows is known.
FILE_ROWS = 50_000


def stage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    ``rows`` is a bound of its rows, if one is known: a small table then comes in a few
    files rather than one for each shuffle partition.

    A lost executor then costs no more than the tasks it ran. The folder goes when
    the driver's interpreter ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    base = shared_dir(spark)
    if base not in _registered:
        _registered.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    schema = df.schema
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again; other DataFrames are left alone."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            _remove(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which is broadcast only if it is counted as small.

    ``right`` should be staged, for it is counted first. Beyond ``rows`` both sides are
    shuffled, and adaptive execution splits hot keys of ``left``.
    """
    if right.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Number the rows of each group gaplessly from 0 without sorting a group in one task.

    ``bucket`` cuts each group into pieces that are ordered among themselves; a piece is
    sorted alone and starts at the sum of the counts before it. The table of counts has a
    row for each group and piece, and is summed in the order of the pieces. Helper columns
    meet no name of ``df``.
    """
    piece, other, n, start = (fresh(df, x) for x in ("piece", "other_piece", "n", "start"))
    of = [fresh(df, f"of_{g}") for g in group]
    cut = df.withColumn(piece, bucket)
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        cut.groupBy(*group, piece).agg(F.count("*").alias(n))
        .withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .select(*[F.col(g).alias(o) for g, o in zip(group, of)], F.col(piece).alias(other), start)
    )
    on = [F.col(g).eqNullSafe(F.col(o)) for g, o in zip(group, of)] + [F.col(piece) == F.col(other)]
    inside = Window.partitionBy(*group, piece).orderBy(*order)
    return join_checked(cut, starts, on).withColumn(out, F.col(start) + F.row_number().over(inside) - 1).drop(piece, other, start, *of)
