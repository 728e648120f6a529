"""The crawl frontier: queues of items with a priority (0 is most urgent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.operators.ordered import running
from trawlframe.session import cut_lineage

# Priority names, in order of urgency.
PRIORITIES = ("CRITICAL", "HIGH", "NORMAL", "LOW", "MINIMAL")

ORDER = ("priority", "ts", "item_id")


def priority_name(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), priority + 1)


def priority_value(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.upper(name)).cast("int") - 1


def ranked(items: DataFrame, queue: str = "queue", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Position of every item in its queue. Queues are few and long, so the
    numbering is spread over segments instead of one task per queue."""
    return running(items, [queue], list(order), count="position")


def next_items(items: DataFrame, k: int, queue: str = "queue", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The next ``k`` items per queue (1: peek). Each map task passes on at
    most its own first ``k`` of a queue."""
    w = Window.partitionBy(queue).orderBy(*order)
    return items.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def bounded(items: DataFrame, maxsize: int, queue: str = "queue", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Marks the items a queue of ``maxsize`` would drop: the least urgent."""
    evicted = F.col("position") > maxsize if maxsize > 0 else F.lit(False)
    return ranked(items, queue, order).withColumn("evicted", evicted)


def apply_commands(items: DataFrame, commands: DataFrame) -> DataFrame:
    """Items after ``commands(item_id, ts, command_id, action, priority)``:
    'remove' or 'update'; the last command per item wins."""
    latest = (commands.groupBy("item_id")
              .agg(F.max_by(F.struct("action", F.col("priority").alias("new_priority")),
                            F.struct("ts", "command_id")).alias("_c"))
              .select("item_id", "_c.action", "_c.new_priority"))
    joined = items.join(latest, "item_id", "left")
    return (joined.where(~F.col("action").eqNullSafe("remove"))
            .withColumn("priority", F.when(F.col("action") == "update", F.col("new_priority"))
                        .otherwise(F.col("priority")))
            .select(*items.columns))


def _wait(now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6


def queue_stats(items: DataFrame, now: Column, maxsize: int = 0) -> DataFrame:
    """Size and waiting times per queue, and the totals as a row with queue null."""
    wait = _wait(now)
    per_queue = items.groupBy("queue").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wait).alias("sum"), F.max(wait).alias("max"), F.min(wait).alias("min"))
    # The roll-up runs over one row per queue, not over the items.
    size = F.coalesce(F.sum("n"), F.lit(0))
    zero = F.lit(0.0)
    return per_queue.rollup("queue").agg(
        F.grouping_id().cast("int").alias("is_total"), F.count(F.lit(1)).alias("queues"), size.alias("queue_size"),
        (size == 0).alias("is_empty"), ((F.lit(maxsize) > 0) & (size >= maxsize)).alias("is_full"),
        F.coalesce(F.sum("sum") / F.sum("n"), zero).alias("average_wait_time"),
        F.coalesce(F.max("max"), zero).alias("max_wait_time"),
        F.coalesce(F.min("min"), zero).alias("min_wait_time"),
        F.coalesce(F.max("max"), zero).alias("oldest_item_wait_time"))


def processed_stats(items: DataFrame, done_at: Column, by: list[str] | None = None) -> DataFrame:
    """Processed items: total, count per priority name, waiting times."""
    wait = _wait(done_at)
    return items.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(F.col("priority") == i).alias(name.lower()) for i, name in enumerate(PRIORITIES)],
        F.coalesce(F.avg(wait), F.lit(0.0)).alias("average_wait_time"),
        F.coalesce(F.max(wait), F.lit(0.0)).alias("max_wait_time"), F.min(wait).alias("min_wait_time"))


def politeness_plan(requests: DataFrame, host: str, order: list[str], *, per_host: int = 5,
                    overall: int = 10, delay_seconds: float = 1.0) -> DataFrame:
    """When each request may go: its number on the host, the host's wave of at
    most ``per_host``, seconds after the start, and the global batch of at most
    ``overall`` when waves are served one after the other."""
    # Numbering reads its input several times: what may be costly to make is stored once, and so are the waves.
    on_host = cut_lineage(running(cut_lineage(requests), [host], order, count="host_position"))
    waves = on_host.withColumn("wave", F.floor((F.col("host_position") - 1) / per_host))
    timed = waves.withColumn("start_after", (F.col("host_position") - 1) * F.lit(float(delay_seconds)))
    numbered = running(timed, [], ["wave", host, *order], count="_overall")
    return numbered.withColumn("batch", F.floor((F.col("_overall") - 1) / overall)).drop("_overall")
