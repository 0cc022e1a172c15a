"""Mixing sources to target weights by Poisson replication; built-in functions only.

A source with target weight w and measured size m out of the total M gets the repetition rate r = epochs * w * M / m. Each
document's number of copies is a Poisson number with mean r: a hash of (seed, id) is the uniform number, and the
Poisson distribution is inverted at it. Copies are then dealt to partitions by a second hash and sorted by it, which is
a shuffle of the whole table that any re-run repeats.

Defined cases: null source is a source of its own; a null text has size 0 and is copied like the others of its
source; a source without characters has rate ``epochs``; rows that repeat an id repeat its number; null ids share the
number of the empty id; an empty table gives no row; extra columns are carried along, and the operator's own columns
are named by ``copy_col`` and ``order_col``, which replace any of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import lookup

#: Size of a source to the power that makes its default target weight: between even (0) and as it is (1).
TEMPERATURE = 0.5
SEED = 17
HEX_DIGITS = 13


def unit_hash(seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1): 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**HEX_DIGITS))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to where the rest is below the hash's resolution. Terms are kept as logarithms."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log(rate / k)).alias("log"), (acc["sum"] + F.exp(acc["log"] + F.log(rate / k))).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(acc["log"] + F.log(rate / k)))).alias("cdf"),
    )
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str, epochs: float, temperature: float) -> DataFrame:
    """One row a source: its key, rows and repetition rate. Without ``weights`` a source's weight is size ** temperature."""
    sizes = docs.groupBy(_key(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.coalesce(F.length(f"`{text_col}`"), F.lit(0))).cast("double").alias("__size"))
    if weights is None:
        target = F.pow("__size", F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))]
        target = F.coalesce(F.create_map(*pairs)[F.col("__source")], F.lit(0.0))
    totals = sizes.agg(F.sum("__size").alias("__all"), F.sum(target).alias("__targets"))  # one row
    rate = F.when((F.col("__size") > 0) & (F.col("__targets") > 0), epochs * F.col("__target") / F.col("__targets") * F.col("__all") / F.col("__size")).otherwise(F.lit(float(epochs)))
    return sizes.withColumn("__target", target).join(F.broadcast(totals)).select("__source", "__rows", rate.alias("__rate"))


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, temperature: float = TEMPERATURE,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", order_col: str = "shuffle_key",
) -> DataFrame:
    """Every copy of every document, shuffled; ``copy_col`` counts a document's copies from 0, ``order_col`` is the place key."""
    rates = source_rates(docs, weights, source_col, text_col, epochs, temperature).withColumn("__cdf", poisson_cdf(F.col("__rate")))
    own = [c for c in docs.columns if c not in (copy_col, order_col)]
    keyed = docs.select(*[F.col(f"`{c}`") for c in own]).withColumns({"__source": _key(source_col), "__u": unit_hash(seed, F.col(f"`{id_col}`"))})
    known = lookup(keyed, rates, ["__source"], "__rows", docs.count(), wide=True)
    # The inverse at u: as many as the distribution's steps that u has passed.
    drawn = known.withColumn("__n", F.size(F.filter("__cdf", lambda p: p <= F.col("__u")))).where("__n > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    placed = copies.withColumn("__order", unit_hash(seed + 1, F.col(f"`{id_col}`"), F.col("__copy")))
    return placed.repartition("__order").sortWithinPartitions("__order").select(
        *[F.col(f"`{c}`") for c in own], F.col("__copy").alias(copy_col), F.col("__order").alias(order_col)
    )
