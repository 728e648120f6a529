"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. The exponent is bisected to the
smallest one in 0 to 1 whose weights neither exceed a target entropy nor repeat a source too often.
The weights are then realised as a budget of tokens for each source: whole passes over the source, and
a last pass over the first blocks of a permutation of its blocks. Built-in functions only; all that
depends on the number of documents is a plain aggregation, and only tables with a row per
source or block are ever sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlframe.llm.common import stored, table
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """``entropy``: target, as a share of the entropy of equal weights (None: no target). ``repeats``: how often a source may be
    passed at most. ``budget``: tokens of the mixture as a multiple of all tokens; None: the smallest mixture in
    which every source is passed at least once, so that no document is left out."""

    entropy: float | None = None
    repeats: float = 4.0
    budget: float | None = None
    block_tokens: int = 65_536
    steps: int = 24
    seed: int = 1


def token_count(text: Column) -> Column:
    """Words between white space (space and the controls 9 to 13); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """The first 60 bits of an MD5 digest, as a number."""
    joined = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _block(s: Settings) -> Column:
    return F.pmod(hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(s.seed)), F.col("n_blocks"))


def budgets(tokens: DataFrame, s: Settings) -> DataFrame:
    """(source, tokens, budget, n_blocks, full, rest) for (source, tokens): the tokens to draw from each source, as
    whole passes and a rest. Sources without tokens are drawn once in the covering mixture and else not at all."""
    listed = (tokens.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("sources"))
              .withColumn("total", F.expr("aggregate(sources, 0L, (z, x) -> z + x.tokens)"))
              .withColumn("p", F.expr("transform(sources, x -> CAST(x.tokens AS DOUBLE) / total)")))
    z = "aggregate(p, 0D, (z, x) -> z + power(x, {a}))"
    # The entropy of weights p^a / z is ln z - a / z * sum(p^a ln p).
    entropy = f"(ln({z}) - {{a}} / {z} * aggregate(p, 0D, (z, x) -> z + power(x, {{a}}) * ln(x)))"
    # A source is passed (w * budget) / (p * total) times, which falls with p: the rarest is passed most often.
    most = (f"power(array_min(p), {{a}} - 1) / {z} * {s.budget!r}D" if s.budget is not None else
            "power(array_min(p) / array_max(p), {a} - 1)")
    flat = f"({most} > {float(s.repeats)!r}D)"
    if s.entropy is not None:
        flat += f" OR ({entropy} > {float(s.entropy)!r}D * ln(size(p)))"
    middle = "((e.lo + e.hi) / 2)"
    bisected = (f"aggregate(sequence(1, {s.steps}), named_struct('lo', 0D, 'hi', 1D), (e, i) -> IF({flat.format(a=middle)}, "
                f"named_struct('lo', {middle}, 'hi', e.hi), named_struct('lo', e.lo, 'hi', {middle}))).hi")
    flat_enough = f"IF({flat.format(a='0D')}, {bisected}, 0D)"
    rows = (listed.withColumn("a", F.expr(flat_enough)).withColumn("z", F.expr(z.format(a="a")))
            .withColumn("size", F.expr(f"CAST(total AS DOUBLE) * {float(s.budget)!r}D" if s.budget is not None else
                                       "array_max(p) * total / (power(array_max(p), a) / z)"))
            .select("total", "a", "z", "size", F.posexplode("sources").alias("i", "one"), "p")
            .select("one.source", "one.tokens", F.expr("CAST(floor(power(p[i], a) / z * size + 0.5D) AS BIGINT)").alias("budget")))
    if s.budget is None:
        rows = (rows.withColumn("budget", F.greatest("budget", "tokens"))
                .unionByName(tokens.where("tokens = 0").select("source", "tokens", F.lit(0).cast("long").alias("budget"))))
    return (rows.withColumn("n_blocks", F.expr(f"greatest(1L, CAST(ceil(tokens / {s.block_tokens}) AS BIGINT))"))
            .withColumn("full", F.expr("IF(tokens = 0, 1L, budget DIV tokens)"))
            .withColumn("rest", F.expr("IF(tokens = 0, 0L, budget % tokens)")))


def plan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(source, tokens, budget, n_blocks, full, last): how documents of each source are drawn.

    A document is drawn ``full`` times and once more if its block's place in the permutation is at most
    ``last``. A null source counts as the empty name; a null or empty text has no tokens.
    """
    s = settings or Settings()
    counted = stored(docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id"), token_count(F.col("text")).alias("tokens")), "tokens")
    sources = stored(budgets(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), s), "budgets")
    # The table of sources is as small as its file says, so Spark broadcasts it, or not, by that size.
    blocks = (counted.join(sources.select("source", "n_blocks", "full", "rest"), "source").withColumn("block", _block(s))
              .groupBy("source", "n_blocks", "full", "rest", "block").agg(F.sum("tokens").alias("tokens"))
              .withColumn("place", hashed(F.col("source"), F.col("block"), F.col("full"), F.lit(s.seed))))
    # Running sums over the permutation, in two levels so that a large source is no single window: slices of about
    # a thousand blocks, then blocks within a slice.
    sliced = blocks.withColumn("slice", F.expr("(place >> 30) * (1L + n_blocks DIV 1000L) >> 30"))
    slices = sliced.groupBy("source", "slice").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "slice").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (sliced.join(slices, ["source", "slice"]).withColumn("upto", F.col("earlier") + F.sum("tokens").over(inside))
             # A block belongs to the last pass if at least half of it is within the rest.
             .where("2 * upto - tokens <= 2 * rest AND rest > 0").groupBy("source").agg(F.max("place").alias("last")))
    return sources.join(taken, "source", "left").select(
        "source", "tokens", "budget", "n_blocks", "full", F.coalesce("last", F.lit(-1)).cast("long").alias("last"))


def drawn(docs: DataFrame, sources: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` with (block, copies): the block of each document and how often the mixture has it.

    ``sources`` is what :func:`plan` gives, stored. Columns of the names block and copies are replaced.
    """
    s = settings or Settings()
    own = [c for c in docs.columns if c not in ("block", "copies")]
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("source"))
    copies = F.col("full") + (hashed(F.col("source"), F.col("block"), F.col("full"), F.lit(s.seed)) <= F.col("last")).cast("long")
    return (rows.join(sources.select("source", "n_blocks", "full", "last"), "source", "left").withColumn("block", _block(s))
            .select("row.*", "block", F.coalesce(copies, F.lit(0)).alias("copies")))


def mixture(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture draws it."""
    s = settings or Settings()
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), "doc_id", "source")
    out = drawn(rows, stored(plan(docs, s), "mix"), s)
    return out.where("copies > 0").withColumn("draw", F.explode(F.expr("sequence(1L, copies)"))).select(
        *(F.col("row").getField(c).alias(c) for c in columns))


QUERY = Settings(entropy=0.95, repeats=4.0, budget=0.75)

SQL = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY source HAVING sum(tokens) > 0),
shares AS (SELECT source, tokens, tokens::DOUBLE / (SELECT sum(tokens) FROM sources) AS p FROM sources),
judged AS (SELECT min(p) AS least, count(*) AS n FROM shares),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS mid
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END, mid
  FROM (SELECT b.step, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid,
               (SELECT pow(j.least, (b.lo + b.hi) / 2 - 1) / sum(pow(p, (b.lo + b.hi) / 2)) * 0.75 > 4.0
                       OR ln(sum(pow(p, (b.lo + b.hi) / 2)))
                          - (b.lo + b.hi) / 2 / sum(pow(p, (b.lo + b.hi) / 2)) * sum(pow(p, (b.lo + b.hi) / 2) * ln(p))
                          > 0.95 * ln(j.n) FROM shares, judged j GROUP BY j.least, j.n) AS flat
        FROM bisect b WHERE b.step < 24)),
flattest AS (
  SELECT (SELECT j.least ** -1.0 / count(*) * 0.75 > 4.0 OR ln(count(*)) > 0.95 * ln(j.n) FROM shares, judged j GROUP BY j.least, j.n) AS flat),
exponent AS (SELECT CASE WHEN (SELECT flat FROM flattest) THEN hi ELSE 0.0 END AS a FROM bisect WHERE step = 24),
budgets AS (
  SELECT source, tokens, greatest(1, ceil(tokens / 65536.0))::BIGINT AS n_blocks,
         floor(pow(p, (SELECT a FROM exponent)) / (SELECT sum(pow(p, (SELECT a FROM exponent))) FROM shares)
               * ((SELECT sum(tokens) FROM sources)::DOUBLE * 0.75) + 0.5)::BIGINT AS budget
  FROM shares),
parts AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM budgets),
docs AS (
  SELECT c.doc_id, c.source, c.tokens, p.whole, p.rest,
         ('0x' || substr(md5(coalesce(c.doc_id::VARCHAR, '') || ':1'), 1, 15))::BIGINT % p.n_blocks AS block
  FROM counted c LEFT JOIN parts p USING (source)),
blocks AS (
  SELECT source, block, whole, rest, sum(tokens)::BIGINT AS tokens,
         ('0x' || substr(md5(source || ':' || block || ':' || whole || ':1'), 1, 15))::BIGINT AS place
  FROM docs WHERE block IS NOT NULL GROUP BY source, block, whole, rest),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place, block) AS upto FROM blocks),
chosen AS (SELECT source, block, (rest > 0 AND 2 * upto - tokens <= 2 * rest)::BIGINT AS more FROM summed)
SELECT d.doc_id, d.source, d.tokens::BIGINT AS n_tokens, d.block, coalesce(d.whole + c.more, 0)::BIGINT AS copies
FROM docs d LEFT JOIN chosen c USING (source, block)
"""


@query("op5_temperature_mix", SQL)
def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block of every document and how often the mixture has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    chosen = stored(plan(docs, QUERY), "mix")
    light = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    return drawn(light, chosen, QUERY)
