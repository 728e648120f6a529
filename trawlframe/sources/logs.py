"""Log sources: one JSON object per line, or plain text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.sources.store import by_bucket, of_task

# The fields of a structured line and the text line's layout.
JSON_LOG_SCHEMA = (
    "message string, timestamp string, level string, logger string, module string, `function` string, line int, "
    "thread long, thread_name string, process long, process_name string, task_id string, url string, status int, "
    "response_time double, _corrupt_record string")
TEXT_LOG = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[([A-Z]+)\] ([^:\s]+): (.*)$"


def parse_json_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Columns of a structured log; a line that is no JSON has readable = false."""
    parsed = lines.withColumn("_l", F.from_json(text, JSON_LOG_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return (parsed.select(*[c for c in lines.columns if c != text], "_l.*")
            .withColumns({"ts": F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                          "readable": F.col("_corrupt_record").isNull()})
            .drop("timestamp", "_corrupt_record"))


def parse_text_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """ts, level, logger, message of text lines; other lines, such as stack traces, are left out and
    counted by :func:`text_log_report`."""
    part = lambda i: F.regexp_extract(text, TEXT_LOG, i)
    return lines.where(F.col(text).rlike(TEXT_LOG)).select(
        *[c for c in lines.columns if c != text],
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        part(2).alias("level"), part(3).alias("logger"), part(4).alias("message"))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_log(spark.read.text(path))


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_text_log(spark.read.text(path))


def text_log_report(lines: DataFrame, text: str = "value") -> DataFrame:
    """``lines, parsed, left_out``: one row."""
    fits = F.coalesce(F.col(text).rlike(TEXT_LOG), F.lit(False))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("parsed"), F.count_if(~fits).alias("left_out"))


def write_task_log(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """JSON lines of ``lines(task_id, line, value)``, in folders by task bucket; ``line`` is the place in the task's log."""
    by_bucket(lines.select("task_id", "line", "value"), buckets).write.mode("append").partitionBy("buckets", "bucket").json(path)


def read_task_log(spark: SparkSession, path: str, key_type: str = "long", task_id=None) -> DataFrame:
    """``task_id, line, value``; for one task only its bucket is read, in order of ``line``."""
    rows = spark.read.schema(f"task_id {key_type}, line long, value string, buckets int, bucket int").json(path)
    if task_id is not None:
        rows = of_task(rows, task_id, key_type).orderBy("line")
    return rows.select("task_id", "line", "value")
