"""Sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import filled


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """`df`, dealt to all cores where it comes from fewer files than cores and is small (`most` bytes by the planner's estimate).

    A file of one row group is read by one task; for a large input there are enough files, and it stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def gathered(df: DataFrame, key: str, rows: int, most: int = 1 << 19) -> DataFrame:
    """`df`, of about `rows` rows, dealt by the key to tasks of about `most` rows each, and to all cores at least.

    For groupBy(key) on rows that lie by another key, as behind a join: partial sums before the exchange would hold an entry for
    nearly each row. Tasks grow in number with the input and not in size. A key's rows go to one task, which keeps one entry for them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // most)), key)


def tsv_projected(spark: SparkSession, path: str, header: list[str], columns: list[str]) -> DataFrame:
    """Some columns of a wide tab-separated file, all as text, blank as null. Only those columns are parsed."""
    schema = ", ".join(f"`{c}` string" for c in header)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "").option("quote", "").csv(path).select(*columns)


def tsv_bad_lines(spark: SparkSession, path: str, header: list[str], types: dict[str, str]) -> DataFrame:
    """Rows of a tab-separated file with `bad_line`: the raw line where it is malformed, else null."""
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header) + ", bad_line string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").csv(path)


def profile_columns(df: DataFrame, pattern: str, n: int | None = None) -> DataFrame:
    """(column, non_null, total) of the columns whose name matches, over the first n rows or all."""
    names = [c for c in df.columns if re.search(pattern, c)]
    rows = df if n is None else df.limit(n)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(filled(c)).alias(c) for c in names])
    return counts.unpivot("total", names, "column", "non_null").select("column", "non_null", "total")


def write_tiers(df: DataFrame, path: str, tier: str, form: str = "parquet") -> None:
    """Append rows to one file set per tier."""
    df.write.partitionBy(tier).mode("append").format(form).save(path)


def append_table(df: DataFrame, target: str | dict, mode: str = "append") -> None:
    """Append to a Parquet path, or through JDBC if `target` holds its options."""
    if isinstance(target, dict):
        df.write.format("jdbc").options(**target).mode(mode).save()
    else:
        df.write.mode(mode).parquet(target)


def truncate_load(df: DataFrame, path: str) -> int:
    """Replace the table at `path`; returns how many rows it had."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    old = spark.read.parquet(path).count() if there else 0
    df.write.mode("overwrite").parquet(path)
    return old


def upsert_by_key(target: DataFrame, source: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Target rows with those of the source put over them by key; of several source rows the last by `order` wins."""
    names = target.columns
    latest = source.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_s"))
    joined = target.join(latest.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "full_outer")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in names])


BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: Column, buckets: int) -> None:
    """A new table at `path`, dealt to buckets by the key: a folder and one file for each. Choose as many as let a bucket fit a task."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def upsert_buckets(path: str, delta: DataFrame, key: Column, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Merge `delta` into the table of `write_buckets` at `path` and rewrite only the buckets that its keys fall into; returns those.

    merge(current, delta) gets the rows of these buckets and must keep each row's key. Buckets are picked by their folders, so others are
    neither read nor written, and are replaced together when all of them are written: a failed run leaves the table as it was.
    """
    spark = delta.sparkSession
    touched = [r[0] for r in delta.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect()]  # at most `buckets` numbers
    if touched:
        current = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = merge(current, delta).withColumn(BUCKET, bucket_of(key, buckets)).repartition(F.col(BUCKET))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return sorted(touched)


def merge_into(source: DataFrame, table: str, key: str) -> None:
    """The same on a catalog table that supports MERGE."""
    source.mergeInto(table, F.expr(f"{table}.{key} = source.{key}")).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def nested_documents(recipes: DataFrame, lines: DataFrame, key: str, position: list[str], fields: list[str]) -> DataFrame:
    """(key, document): a JSON document per recipe with its ordered lines."""
    grouped = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*position, *[c for c in fields if c not in position]))).alias("_l"))
    listed = F.transform(F.coalesce("_l", F.array().cast(grouped.schema["_l"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    joined = recipes.join(grouped, key, "left")
    return joined.select(key, F.to_json(F.struct(*recipes.columns, listed.alias("ingredients"))).alias("document"))


def explode_documents(documents: DataFrame, schema: str, array: str) -> DataFrame:
    """Rows of a document's array with their position; a document without any gives one row of nulls."""
    parsed = documents.select(F.from_json("document", schema).alias("r"))
    return parsed.select("r.*").select("*", F.posexplode_outer(array).alias("pos", "line")).drop(array)
