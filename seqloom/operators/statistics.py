"""Histograms of counters and what is read off them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_histogram(table: DataFrame) -> DataFrame:
    return table.groupBy("value").agg(F.count("*").alias("freq"))


def clipped_histogram(values: DataFrame, column: str, top: int = 15) -> DataFrame:
    return values.groupBy(F.least(F.col(column), F.lit(top).cast("bigint")).alias("value")).agg(F.count("*").alias("freq"))


def fractions(histogram: DataFrame) -> DataFrame:
    """value, freq, shares of all and of the positive ones, and the averages over each.

    A histogram has as many rows as there are values, so the windows over all of it stay small.
    """
    everything = Window.partitionBy()
    total, weighted = F.sum("freq").over(everything), F.sum(F.col("value") * F.col("freq")).over(everything)
    positive = F.sum(F.when(F.col("value") > 0, F.col("freq")).otherwise(0)).over(everything)
    return histogram.select(
        "value", "freq", (F.col("freq") / total).alias("share"), F.when(F.col("value") > 0, F.col("freq") / positive).alias("positive_share"),
        (weighted / total).alias("average"), F.when(positive > 0, weighted / positive).alias("positive_average"),
    )


def tail(histogram: DataFrame, least: tuple[int, ...] = (1, 2, 10)) -> DataFrame:
    """For each count t the largest value that t items or more reach."""
    reach = F.sum("freq").over(Window.orderBy(F.col("value").desc()))
    wanted = F.explode(F.array(*[F.lit(t) for t in least])).alias("at_least")
    return histogram.withColumn("reach", reach).select("value", "reach", wanted).filter("reach >= at_least").groupBy("at_least").agg(F.max("value").alias("value"))


def dense(histogram: DataFrame) -> DataFrame:
    """The histogram with zero rows for all values from 0 to the largest."""
    values = histogram.agg(F.max("value").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top").cast("bigint"))).alias("value"))
    return values.join(histogram, "value", "left").select("value", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def solid_threshold(histogram: DataFrame, start: int = 1, default: int = 1) -> DataFrame:
    """threshold: the first value after start at which the dense histogram rises; solid: items at or above it."""
    rising = dense(histogram).filter("value > 0").withColumn("before", F.lag("freq").over(Window.orderBy("value")))
    first = rising.filter((F.col("value") > start) & (F.col("freq") > F.col("before"))).agg(F.coalesce(F.min("value"), F.lit(default).cast("bigint")).alias("threshold"))
    joined = first.join(histogram.filter("value > 0"), F.col("value") >= F.col("threshold"), "left")
    return joined.groupBy("threshold").agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("solid"))


def histogram_2d(pairs: DataFrame) -> DataFrame:
    """c1, c2, freq, percent of all rows (c1, c2), rounded half even."""
    counted = pairs.groupBy("c1", "c2").agg(F.count("*").alias("freq"))
    return counted.withColumn("percent", F.bround(100 * F.col("freq") / F.sum("freq").over(Window.partitionBy()), 2))


def histogram_2d_wide(pairs: DataFrame, columns: list[int]) -> DataFrame:
    """One row a c1, a column for each given c2."""
    return pairs.groupBy("c1").pivot("c2", columns).count().na.fill(0)


def group_sizes(sequences: DataFrame, group: str, seq: str = "seq", offset: int = 0, override: int | None = None) -> DataFrame:
    """group, size: the sum of lengths plus offset, or a constant."""
    total = F.sum(F.length(seq) + offset) if override is None else F.max(F.lit(override))
    return sequences.groupBy(group).agg(F.count("*").alias("n_sequences"), total.cast("bigint").alias("size"))


def size_bounds(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    return sequences.agg(F.count("*").alias("n_sequences"), F.sum(F.length(seq)).cast("bigint").alias("total"), F.max(F.length(seq)).cast("bigint").alias("longest"))
