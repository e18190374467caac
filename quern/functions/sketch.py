"""Shingle sketches, SimHash and similarities as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, SKETCH = 5, 128
#: Least similarity of each kind in a probable pair.
NEAR = 0.9
#: Digits of MD5 that make a hash: sixty bits, never negative.
HASH_DIGITS, HASH_BITS = 15, 60


def hash60(x: Column) -> Column:
    """A stable number from sixty bits of MD5."""
    return F.conv(F.left(F.md5(x), F.lit(HASH_DIGITS)), 16, 10).cast("long")


def unicode_words(x) -> Column:
    """X06"""
    return F.regexp_extract_all(x if isinstance(x, Column) else F.col(x), F.lit(r"((?U)\w+)"), F.lit(1))


def bottom_sketch(words: str, size: int = SHINGLE, keep: int = SKETCH) -> Column:
    """The smallest distinct hashes of the shingles of a word array column, sorted; fewer words make one shingle, none an empty sketch."""
    w = F.col(words)
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1))
    hashes = F.transform(starts, lambda i: hash60(F.array_join(F.slice(w, i, size), " ")))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, keep))


def simhash(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, simhash) over the words with repetition; a bit is set where its votes are not negative; no words give 0."""
    each = df.select(key, F.explode_outer(words).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("c"))
    hashed = each.select(key, F.when(F.col("w").isNotNull(), hash60(F.col("w"))).alias("h"), F.when(F.col("w").isNotNull(), F.col("c")).otherwise(0).alias("c"))
    votes = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("c")).otherwise(-F.col("c"))).alias(f"v{b}") for b in range(HASH_BITS)]
    summed = hashed.groupBy(key).agg(F.count("h").alias("n"), *votes)
    bits = sum((F.when(F.col(f"v{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(HASH_BITS)), F.lit(0).cast("long"))
    return summed.select(key, F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(bits).alias("simhash"))


def overlap(a: str, b: str) -> Column:
    """Shared hashes over the smaller sketch; 0 where one is empty."""
    low = F.least(F.size(a), F.size(b))
    return F.when(low > 0, F.size(F.array_intersect(a, b)) / low).otherwise(F.lit(0.0))


def simhash_similarity(a: str, b: str, bits: int = HASH_BITS) -> Column:
    """X10"""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(bits)


def length_similarity(a: str, b: str) -> Column:
    """X11"""
    return F.when(F.least(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def pair_class(exact: Column, shingle: str, sim: str, length: str) -> Column:
    """X13"""
    near = (F.col(shingle) >= NEAR) & (F.col(sim) >= NEAR) & (F.col(length) >= NEAR)
    look = ((F.col(shingle) >= 0.7) & (F.col(length) >= 0.8)) | ((F.col(shingle) >= 0.8) & (F.col(sim) >= 0.8))
    return F.when(exact, "exact_duplicate").when(near, "probable_near_duplicate").when(look, "review").otherwise("likely_distinct")


def pair_confidence(exact: Column, shingle: str, sim: str, length: str, title: str) -> Column:
    """X13"""
    return F.when(exact, F.lit(1.0)).otherwise(0.5 * F.col(shingle) + 0.25 * F.col(sim) + 0.2 * F.col(length) + 0.05 * F.col(title))
