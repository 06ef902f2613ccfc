"""Shared helpers of the training-data operators: staged tables, vocabularies, skew-safe ranks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the operators on words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def own_names(docs: DataFrame, *others: str) -> Callable[[str], str]:
    """Names for an operator's own columns that none of ``docs`` has, and none of ``others``, without regard to case."""
    taken, prefix = [c.lower() for c in (*docs.columns, *others)], "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return lambda name: prefix + name


def kept_columns(docs: DataFrame, out: str) -> list[Column]:
    """The caller's columns, without one that ``out`` replaces; Spark doesn't tell case apart."""
    return [F.col(quoted(c)) for c in docs.columns if c.lower() != out.lower()]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` uses it, also in functions of elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where it names none a temporary one serves, but only if all run on this machine; else an error, since
    executors wouldn't see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_OPENED: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a part of it that goes when the driver ends."""
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if root not in _OPENED:
        _OPENED.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended: its folder stays, as a cluster's own checkpoints do
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what was computed outlives the executors that computed it, and is
    computed once however often it is used.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been staged: it does once the driver has forgotten their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a table of ``staged`` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            _remove(spark, folder)


#: Totals of at most so many groups and buckets are broadcast, a few MB; more are joined.
_MOST_BROADCAST = 1 << 16


def with_ordinals(df: DataFrame, group: list, order: list, name: str, buckets: int = 512, bucket=None, weight=None, groups: int | None = None) -> DataFrame:
    """Add ``name``: the number of rows before each row (or their total ``weight``) within ``group``.

    Rows are numbered by (bucket, ``order``), the bucket being a hash of ``order`` unless ``bucket`` is
    given.  A group is never gathered in one task: each (group, bucket) is numbered apart and starts at
    the total of the buckets before it.  Those totals are broadcast only if ``groups``, a bound of the
    number of groups that the caller knows, makes them few.
    """
    from pyspark.sql import Window as W

    own = own_names(df, name)
    keys = [F.col(quoted(c)) for c in group]
    b = bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(buckets))
    given = df.withColumn(own("b"), b.cast("long"))
    size = F.lit(1).cast("long") if weight is None else weight.cast("long")
    totals = given.groupBy(*keys, own("b")).agg(F.sum(size).alias(own("n")))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(own("b")).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[k.alias(own(f"g{i}")) for i, k in enumerate(keys)], F.col(own("b")).alias(own("sb")), F.coalesce(F.sum(own("n")).over(before), F.lit(0)).alias(own("start")))
    inside = W.partitionBy(*keys, own("b")).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    numbered = given.withColumn(own("i"), F.coalesce(F.sum(size).over(inside), F.lit(0)))
    on = F.col(own("b")) == F.col(own("sb"))
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(own(f"g{i}")))
    few = buckets * (groups if groups is not None else 1 if not keys else _MOST_BROADCAST) <= _MOST_BROADCAST
    joined = numbered.join(F.broadcast(starts) if few else starts.hint("merge"), on)
    return joined.select(*kept_columns(df, name), (F.col(own("start")) + F.col(own("i"))).alias(name))
