"""Task, result and page tables: Parquet by default, JDBC where a database is
the store; results also as JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.operators.ordered import running

RESULT_DEFAULTS = {"url": "", "status_code": 0, "response_time": 0.0}


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """A database table in as many parallel reads as there are predicates; they
    must be disjoint and together cover the table."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def _bucket(task_id: Column) -> Column:
    return F.pmod(F.hash(task_id), F.col("buckets"))


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows brought together by bucket, so that a folder gets few files; a large
    bucket is split again by the rebalancing. The number of buckets is a folder level of its own, so it
    is kept with the table and may change from one append to the next."""
    numbered = rows.withColumn("buckets", F.lit(buckets))
    return numbered.withColumn("bucket", _bucket(F.col("task_id"))).hint("rebalance", "bucket")


def of_task(rows: DataFrame, task_id, key_type) -> DataFrame:
    """The rows of one task; only its buckets are read."""
    key = F.lit(task_id).cast(key_type)
    return rows.where((F.col("bucket") == _bucket(key)) & (F.col("task_id") == key))


def append_results(results: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends result rows with the defaults filled in, in folders by task
    bucket: the number of folders does not grow with the number of tasks. Files are
    sorted by task, so that the statistics of their row groups and pages leave out all but those of a task that is looked up."""
    columns = set(results.columns)
    filled = results.withColumns({
        name: F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)
        for name, default in RESULT_DEFAULTS.items()})
    if "data" not in columns:
        filled = filled.withColumn("data", F.lit("{}"))
    # The upper folder is written into by name: as a constant column it would make the writer sort by folder alone.
    ordered = by_bucket(filled, buckets).drop("buckets").sortWithinPartitions("bucket", "task_id")
    ordered.write.mode("append").partitionBy("bucket").parquet(f"{path.rstrip('/')}/buckets={buckets}")


def read_results(spark: SparkSession, path: str, task_id=None) -> DataFrame:
    """Stored result rows; for one task only its bucket is read."""
    rows = spark.read.parquet(path)
    if task_id is not None:
        rows = of_task(rows, task_id, rows.schema["task_id"].dataType)
    return rows.drop("buckets", "bucket")


def result_envelopes(results: DataFrame, order: list[str], export_time: Column, max_rows: int = 10_000) -> DataFrame:
    """``task_id, part, export_time, result_count, results[]``. A task's results
    are numbered and cut into parts of ``max_rows``, so no array is unbounded."""
    numbered = running(results, ["task_id"], order, count="_n")
    fields = [c for c in results.columns if c != "task_id"]
    parts = numbered.groupBy("task_id", F.floor((F.col("_n") - 1) / max_rows).cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("r")))).alias("_r"))
    return parts.select("task_id", "part", export_time.alias("export_time"), "result_count",
                        F.transform("_r", lambda x: x["r"]).alias("results"))


def save_results(results: DataFrame, path: str, order: list[str], export_time: Column, max_rows: int = 10_000, buckets: int = 64) -> None:
    """Appends the envelopes as lines of JSON in gzip files; a bucket is several files once it is large, so they are still read in parallel."""
    envelopes = result_envelopes(results, order, export_time, max_rows)
    by_bucket(envelopes, buckets).write.mode("append").partitionBy("buckets", "bucket").option("compression", "gzip").json(path)


def load_results(spark: SparkSession, path: str, row_schema: T.StructType | str, key_type: str = "long", task_id=None) -> DataFrame:
    """Rows of the envelopes; unreadable lines and files are skipped, :func:`unreadable_results` counts the lines, :func:`unreadable_files` names the files."""
    row = T.StructType.fromDDL(row_schema) if isinstance(row_schema, str) else row_schema
    schema = f"task_id {key_type}, part int, result_count long, results array<{row.simpleString()}>, buckets int, bucket int"
    envelopes = (spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path))
    if task_id is not None:
        envelopes = of_task(envelopes, task_id, key_type)
    return envelopes.select("task_id", F.explode("results").alias("r")).select("task_id", "r.*")


def unreadable_results(spark: SparkSession, path: str, row_schema: T.StructType | str, key_type: str = "long") -> DataFrame:
    """``lines, unreadable``: one row, what :func:`load_results` reads and leaves out."""
    row = T.StructType.fromDDL(row_schema) if isinstance(row_schema, str) else row_schema
    schema = f"task_id {key_type}, part int, result_count long, results array<{row.simpleString()}>, _bad string"
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.option("recursiveFileLookup", True).text(path).select(parsed.alias("e")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("e._bad").isNotNull()).alias("unreadable"))


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files below ``path`` that hold bytes but of which :func:`load_results` can read no line."""
    read = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(path)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.col("_metadata.file_path").alias("path"), "length").where(F.col("length") > 0))
    return files.join(read.select(F.col("_metadata.file_path").alias("path")).distinct(), "path", "left_anti")


def save_configs(configs: DataFrame, path: str) -> None:
    """Appends ``configs(task_id, created_at, config)``; every version is kept."""
    configs.select("task_id", "created_at", F.col("config").cast("string").alias("config")).write.mode("append").json(path)


def latest_configs(configs: DataFrame) -> DataFrame:
    return configs.groupBy("task_id").agg(
        F.max_by("config", F.struct("created_at", "config")).alias("config"), F.max("created_at").alias("created_at"))


def load_configs(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    return latest_configs(spark.read.schema(f"task_id {key_type}, created_at timestamp, config string").json(path))


def file_inventory(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """``category, path, length, modified`` of stored files. The content column
    is pruned, so the files are listed but not opened."""
    rows = None
    for category, path in folders.items():
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select(F.lit(category).alias("category"), "path", "length", F.col("modificationTime").alias("modified")))
        rows = files if rows is None else rows.unionByName(files)
    return rows
