"""Vectors in array columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.signal import total
from voxloom.functions.tokens import let


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, null for empty ones or unequal sizes."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(size > 0, dot(a, b) / size).otherwise(0.0))


def clipped_dot(a: Column, b: Column, least: float = -1.0) -> Column:
    """Dot product of unit vectors, in ``least`` to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(least), dot(a, b)))


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(x)))


def drift(windows: DataFrame, item: str, position: str, embedding: str, reference: str) -> DataFrame:
    """Identity over the windows of each item against its reference: (item, score,
    minimum_similarity, mean_similarity, window_std, adjacent_similarity).

    An item is one recording, so a window over it is bounded by its length."""
    w = Window.partitionBy(item).orderBy(position)
    own = windows.select(item, cosine(F.col(embedding), F.col(reference)).alias("_s"), cosine(F.col(embedding), F.lag(embedding).over(w)).alias("_a"))
    per = own.groupBy(item).agg(F.min("_s").alias("minimum_similarity"), F.avg("_s").alias("mean_similarity"), F.stddev_pop("_s").alias("window_std"), F.coalesce(F.avg("_a"), F.lit(1.0)).alias("adjacent_similarity"))
    score = 0.7 * F.greatest(F.lit(0.0), F.col("minimum_similarity")) + 0.3 * F.greatest(F.lit(0.0), F.col("adjacent_similarity")) - F.col("window_std")
    return per.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
