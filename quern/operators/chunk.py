"""Word-window chunks and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: window, overlap and first index of the three chunkers.
RETRIEVAL, RETRIEVAL_V1, SCENARIO = (320, 50, 0), (220, 40, 1), (180, 40, 0)


def chunk_count(n_words: Column, window: int, overlap: int) -> Column:
    """One chunk up to a window's words, then one more for every started stride."""
    more = F.ceil((n_words - window) / F.lit(window - overlap))
    return F.when(n_words <= window, F.lit(1)).otherwise(1 + more).cast("long")


def chunk(docs: DataFrame, key: str, text: str, layout: tuple[int, int, int] = RETRIEVAL, min_words: int = 1) -> DataFrame:
    """(key, chunk_index, chunk_count, word_start, word_end, word_count, text); texts under `min_words` give none."""
    window, overlap, base = layout
    stride = window - overlap
    worded = docs.select(key, T.words(text).alias("w")).where(F.size("w") >= min_words)
    # the words are bound once; explode_outer keeps the split from being pushed below the generator
    starts = F.transform(F.sequence(F.lit(0), chunk_count(F.size("w"), window, overlap).cast("int") - 1), lambda i: i * stride)
    cut = F.transform(starts, lambda s, i: F.struct((i + base).cast("long").alias("chunk_index"), s.cast("long").alias("word_start"), F.slice("w", s + 1, window).alias("part")))
    rows = worded.select(key, F.size(starts).cast("long").alias("chunk_count"), F.explode_outer(cut).alias("c"))
    return rows.select(
        key,
        "c.chunk_index",
        "chunk_count",
        "c.word_start",
        (F.col("c.word_start") + F.size("c.part")).alias("word_end"),
        F.size("c.part").cast("long").alias("word_count"),
        F.array_join("c.part", " ").alias("text"),
    )


def chunk_histogram(counts: DataFrame, column: str) -> DataFrame:
    """A07"""
    c = F.col(column)
    bucket = F.when(c == 1, "1").when(c <= 5, "2-5").when(c <= 20, "6-20").when(c <= 100, "21-100").otherwise("101+")
    return counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum(c).alias("chunks"))


def spans(points: DataFrame, key: str, start: str, whole: str) -> DataFrame:
    """Adds `end`, the next start of the same key, or the whole length after the last."""
    from pyspark.sql import Window

    return points.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), F.col(whole)))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of a key whose half-open [start, end) overlap; the key keeps the range join an equi-join."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")))
