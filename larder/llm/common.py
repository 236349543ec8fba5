"""Shared helpers of the training-data operators: scratch tables, row numbers, joins with groups, and text keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and the code points 9 to 13.
WS = r"[\x20\x09-\x0D]+"
#: A row's number in its scratch table.
ROW = "_row"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for tables between jobs: under `spark.checkpoint.dir`, which every executor shares.

    Only a local session (tests) may leave that setting unset; it then uses a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/larder-llm/{spark.sparkContext.applicationId}"


#: The folder inside that one, for tables that are deleted together.
_SCOPE: list[str] = []


@contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Scratch tables that are made inside go to a folder of this name."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([scratch_root(spark), *_SCOPE, f"{name}-{uuid.uuid4().hex}"])


def drop_scratch(spark: SparkSession, scope: str | None = None) -> None:
    """Delete every scratch table of this application, or of a scope. Call it when no result that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join([scratch_root(spark), *([scope] if scope else [])]))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reads_scope(df: DataFrame, scope: str) -> bool:
    """Whether `df` reads scratch tables of the scope, by the folders in its plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    folders = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            folders.append(leaf.relation().location().rootPaths().mkString(" "))
    return any(f"/{scope}/" in f for f in folders)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new scratch table and read it back: lineage ends, lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """`df`, dealt to all cores where it comes from fewer files than cores and is small (`most` bytes by the planner's estimate).

    A file of one row group is read by one task; for a large input there are enough files, and it stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a scratch table with a number per row; the numbers are fixed once a task's file is committed."""
    return staged(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def packed(df: DataFrame, *more: Column, carry: list[str] | None = None) -> DataFrame:
    """`df` as `_d`, a struct of its `carry` columns (default: all), and `_tie`, a hash of all: no column can clash with an
    operator's own, and rows have an order that doesn't depend on how they lie in files. Further columns as given."""
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    kept = [F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]
    return df.select(F.struct(*kept).alias("_d"), F.xxhash64(*hashed).alias("_tie"), *more)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them until no column of `df` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` again."""
    return df.select(*[F.col("_d").getField(c).alias(c) for c in like.columns])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int, hot_share: int = 2_000) -> DataFrame:
    """Inner join of `rows` with a table that has one row per group and the group's `size`, and at most `n_rows` in all.

    A group of more than n_rows / hot_share rows never meets in one task: there are at most `hot_share` such groups, and
    those are broadcast. Both tables should be scratch tables, since each is read more than once.
    """
    least = max(64, n_rows // hot_share)
    hot = groups.filter(F.col(size) > least)
    warm = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= least), keys)
    return warm.unionByName(cold)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at `path`, or None where nothing was written yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.schema(schema).parquet(path)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_bucket))
