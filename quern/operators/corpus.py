"""Corpus build, profile, exact and near duplicates, clusters and the clean corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import sketch as S
from quern.functions import text as T
from quern.operators.assemble import numbered
from quern.operators.components import connected_components
from quern.operators.sketch_join import sketches
from quern.sources.scratch import Scratch

MIN_CHARS = 100
#: Documents of a block that a task compares with as many others.
CELL_ROWS = 128


def first_wins(df: DataFrame, content: Column, *order) -> DataFrame:
    """Of rows with equal content the first in the given order; adds `rank`, 1 for the row that stays."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.sha2(content, 256)).orderBy(*order)))


def _cleaned(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, source, lang, text) of the texts that are long enough once they are clean."""
    # one struct, unfolded: a filter on the length would else be pushed below and clean each text again
    clean = F.struct("doc_id", "source", "lang", T.clean_corpus_text("text").alias("text"))
    return docs.select(F.inline(F.array(clean))).where(F.length("text") >= min_chars)


def _first_of_text(long: DataFrame, key: str, *carried) -> DataFrame:
    """Per text hash what the first row by source and id carries, nulls last; a minimum combines before the shuffle, and no text is shuffled."""
    order = F.struct(F.col("source").isNull(), "source", F.col("doc_id").isNull(), "doc_id", F.struct(*carried).alias("own"))
    return long.groupBy(key).agg(F.min(order)["own"].alias("own")).select("own.*")


def built_sizes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, source, lang, characters) of the rows of build_corpus(), in one pass over the texts."""
    long = _cleaned(docs, min_chars).select("doc_id", "source", "lang", F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("h"))
    return _first_of_text(long, "h", "doc_id", "source", "lang", "characters")


def build_corpus(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Clean (N01), drop short texts (F01), keep the first of equal texts (W10) by source and id, nulls last; of rows equal in these too, one."""
    # the clean texts are written: they are read for their hashes and once more for the rows that stay
    scratch = Scratch(docs.sparkSession, "corpus")
    long = scratch.cut(_cleaned(docs, min_chars).select("*", F.sha2("text", 256).alias("h"), F.monotonically_increasing_id().alias("row")), "clean")
    first = _first_of_text(long, "h", F.col("row").alias("first"))
    return long.join(first, F.col("row") == F.col("first"), "left_semi").select("doc_id", "source", "lang", "text")


def size_profile(df: DataFrame, by: str, chars: str, words: str, tokens: str) -> DataFrame:
    """Per group documents, sums, shares of the whole, mean, median, p95 and maximum."""
    whole = Window.partitionBy()
    sums = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(chars).alias("characters"),
        F.sum(words).alias("words"),
        F.sum(tokens).alias("tokens"),
        F.round(F.avg(tokens), 6).alias("average_tokens"),
        F.round(F.percentile(tokens, F.lit(0.5)), 6).alias("median_tokens"),
        F.round(F.percentile(tokens, F.lit(0.95)), 6).alias("p95_tokens"),
        F.max(tokens).alias("max_tokens"),
    )
    return sums.withColumns(
        {
            "documents_percent": F.round(100.0 * F.col("documents") / F.sum("documents").over(whole), 3),
            "token_percent": F.round(100.0 * F.col("tokens") / F.sum("tokens").over(whole), 3),
        }
    )


def percentiles(df: DataFrame, column: str, points: tuple[float, ...]) -> DataFrame:
    """(point, value), linear between ranks."""
    found = df.agg(F.percentile(column, F.array(*map(F.lit, points))).alias("v"))
    pairs = F.arrays_zip(F.array(*map(F.lit, points)).alias("point"), F.col("v").alias("value"))
    return found.select(F.explode(pairs).alias("p")).select(F.col("p.point").alias("point"), F.round("p.value", 6).alias("value"))


def thresholds(df: DataFrame, column: str, levels: tuple[float, ...]) -> DataFrame:
    """How many rows reach each level."""
    counts = df.agg(*(F.count_if(F.col(column) >= level).alias(f"at_{i}") for i, level in enumerate(levels)))
    pairs = F.array(*(F.struct(F.lit(float(level)).alias("level"), F.col(f"at_{i}").alias("n")) for i, level in enumerate(levels)))
    return counts.select(F.inline(pairs))


def quality_exclusions(df: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """(key, primary_reason, all_reasons) of the rows that meet a rule; rules in order of rank."""
    reasons = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)))
    return df.select(key, reasons.alias("r")).where(F.size("r") > 0).select(key, F.col("r")[0].alias("primary_reason"), F.array_join("r", "; ").alias("all_reasons"))


def merge_exclusions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' reasons; the left primary reason wins."""
    a, b = left.alias("a"), right.alias("b")
    split = lambda side: F.split(F.col(f"{side}.all_reasons"), "; ")
    none = F.array().cast("array<string>")
    union = F.array_union(F.coalesce(split("a"), none), F.coalesce(split("b"), none))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("a.primary_reason", "b.primary_reason").alias("primary_reason"), F.array_join(union, "; ").alias("all_reasons")
    )


def fingerprints(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, title, words, characters, exact_hash, signature, simhash, block), written once: pair queries read it many times.

    Texts are sketched where they lie. Rows of one id share the simhash of all their words, which alone are counted by id.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fingerprints")
    norm = docs.select("doc_id", "title", T.for_duplicates("text").alias("t"))
    carried = F.struct("doc_id", "title", F.length("t").cast("long").alias("characters"), F.sha2("t", 256).alias("exact_hash")).alias("id")
    sized = norm.select(carried, F.array_join(S.unicode_words("t"), " ").alias("w"))
    kind = sized.schema["id"].dataType.simpleString()
    each = sized.mapInArrow(sketches(S.SHINGLE, S.SKETCH), f"id {kind}, words long, signature array<long>, simhash long").select("id.*", "words", "signature", "simhash")
    # tables of known size: few repeated ids are broadcast, and no text is shuffled for them; mostly there are none
    again = scratch.cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        both = each.withColumn("voted", F.lit(None).cast("long"))
    else:
        repeated = norm.join(again, "doc_id", "left_semi").select("doc_id", S.unicode_words("t").alias("w"))
        votes = scratch.cut(S.simhash(repeated, "doc_id", "w").withColumnsRenamed({"doc_id": "again", "simhash": "voted"}), "votes")
        both = each.join(votes, F.col("doc_id") == F.col("again"), "left")
    there = lambda c: F.when(F.col("characters").isNotNull(), F.col(c)).alias(c)
    simhash = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("voted", "simhash")).cast("long").alias("simhash")
    prints = both.select("doc_id", "title", there("words"), "characters", "exact_hash", there("signature"), simhash)
    # the case key of a corpus without case numbers: documents that share their smallest shingle
    return scratch.cut(prints.withColumn("block", F.get("signature", F.lit(0))), "fingerprints")


def near_duplicate_pairs(prints: DataFrame) -> DataFrame:
    """The pairs inside each block, with their similarities, class and confidence.

    A block of more than CELL_ROWS documents is cut into a grid of cells, so that its pairs spread over tasks; each pair meets in one cell.
    """
    terms = F.array_distinct(F.split(T.title_key("title"), " ")).alias("terms")
    many = prints.where("block is not null").groupBy("block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CELL_ROWS)
    hot = Scratch(prints.sparkSession, "blocks").cut(many.select(F.col("block").alias("hot"), F.ceil(F.col("rows") / CELL_ROWS).alias("cells")), "hot")
    own = prints.join(hot, F.col("block") == F.col("hot"), "left").select(*prints.columns, terms, F.coalesce("cells", F.lit(1)).alias("cells"))
    own = own.withColumn("cell", F.pmod(F.xxhash64("doc_id"), "cells"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in [*prints.columns, "terms"]]
    a = own.select(*side("a"), F.col("cell").alias("row_a"), every.alias("column_a"))
    b = own.select(*side("b"), F.col("cell").alias("column_b"), every.alias("row_b"))
    same = (F.col("block_a") == F.col("block_b")) & (F.col("row_a") == F.col("row_b")) & (F.col("column_a") == F.col("column_b"))
    pairs = a.join(b, same & (F.col("doc_id_a") < F.col("doc_id_b")))
    exact = F.col("exact_hash_a") == F.col("exact_hash_b")
    # one struct, unfolded: a filter on the class would else be pushed into the join and work out each similarity several times
    scores = F.struct(
        F.col("block_a").alias("case_key"),
        F.col("doc_id_a").alias("id_a"),
        F.col("doc_id_b").alias("id_b"),
        exact.alias("exact_normalized_match"),
        # equal texts have equal sketches, and rows of a block have one
        F.when(exact, F.lit(1.0)).otherwise(S.overlap("signature_a", "signature_b")).alias("shingle"),
        S.simhash_similarity("simhash_a", "simhash_b").alias("sim"),
        ((S.length_similarity("words_a", "words_b") + S.length_similarity("characters_a", "characters_b")) / 2).alias("length"),
        S.token_jaccard(F.col("terms_a"), F.col("terms_b")).alias("title"),
    )
    scored = pairs.select(F.inline(F.array(scores)))
    e = F.col("exact_normalized_match")
    return scored.withColumns({"classification": S.pair_class(e, "shingle", "sim", "length"), "confidence": S.pair_confidence(e, "shingle", "sim", "length", "title")})


def pair_groups(pairs: DataFrame) -> DataFrame:
    """A10: per block the pairs of each class, the best confidence and the ids."""
    counts = {
        f"{c}_pairs": F.count_if(F.col("classification") == c) for c in ("exact_duplicate", "probable_near_duplicate", "review", "likely_distinct")
    }
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("id_a", "id_b")))))
    grouped = pairs.groupBy("case_key").agg(F.count(F.lit(1)).alias("pair_count"), *(v.alias(k) for k, v in counts.items()), F.round(F.max("confidence"), 4).alias("highest_confidence"), ids.alias("ids"))
    return grouped.withColumn("document_count", F.size("ids").cast("long")).withColumn("document_ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), " | ")).drop("ids")


def cluster_edges(prints: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id_a, id_b, classification): edges that connect what all pairs connect, one for each copy of a text.

    Copies of a text share its sketches, so they share the class of any pair: they are linked with the one of the smallest
    id, and those alone meet in the blocks. A group of n copies gives n - 1 edges in place of all its pairs.
    """
    scratch = scratch or Scratch(prints.sparkSession, "clusters")
    blocked = prints.where("block is not null")
    shared = [c for c in prints.columns if c not in ("doc_id", "exact_hash")]
    first = scratch.cut(blocked.groupBy("exact_hash").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in shared)), "texts")
    copies = blocked.select("exact_hash", F.col("doc_id").alias("id_b")).join(first.select("exact_hash", F.col("doc_id").alias("id_a")), "exact_hash").where("id_a <> id_b")
    between = near_duplicate_pairs(first).select("id_a", "id_b", "classification")
    return copies.select("id_a", "id_b", F.lit("exact_duplicate").alias("classification")).union(between)


def duplicate_clusters(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component, cluster_id, cluster_size) over exact and probable pairs; ids number the clusters by size, largest first."""
    scratch = scratch or Scratch(pairs.sparkSession, "clusters")
    edges = pairs.where(F.col("classification").isin("exact_duplicate", "probable_near_duplicate"))
    groups = scratch.cut(connected_components(edges, "id_a", "id_b", scratch), "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size")).withColumn("__less", -F.col("cluster_size"))
    placed = numbered(sizes, ["__less", "component"], "place", scratch)
    named = placed.select("component", "cluster_size", T.numbered_id("dup_cluster_", F.col("place") + 1, 5).alias("cluster_id"))
    return groups.join(named, "component").select(F.col("node").alias("doc_id"), "component", "cluster_id", "cluster_size")


def canonical_members(members: DataFrame, key: str, cluster: str, *order) -> DataFrame:
    """Adds `canonical`, the key of the first member of its cluster in the given order, then by key."""
    first = F.first_value(key).over(Window.partitionBy(cluster).orderBy(*order, key))
    return members.withColumn("canonical", first)


def completeness(*columns: str) -> Column:
    """How many of the fields are present."""
    return reduce(lambda a, b: a + b, (F.coalesce(T.empty_to_null(c).isNotNull(), F.lit(False)).cast("int") for c in columns))


def before_after(before: DataFrame, after: DataFrame, by: str, tokens: str) -> DataFrame:
    """Per group documents and tokens before, after and removed, and the share that stays."""
    a = before.groupBy(by).agg(F.count(F.lit(1)).alias("docs_before"), F.sum(tokens).alias("tokens_before"))
    b = after.groupBy(F.col(by).alias("k")).agg(F.count(F.lit(1)).alias("docs_after"), F.sum(tokens).alias("tokens_after"))
    both = a.join(b, F.col(by) == F.col("k"), "full_outer").select(
        F.coalesce(by, "k").alias(by), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("docs_before", "tokens_before", "docs_after", "tokens_after"))
    )
    kept = F.when(F.col("tokens_before") > 0, F.round(100.0 * F.col("tokens_after") / F.col("tokens_before"), 3))
    return both.withColumns({"docs_removed": F.col("docs_before") - F.col("docs_after"), "tokens_removed": F.col("tokens_before") - F.col("tokens_after"), "retained_percent": kept})


def multiset_difference(left: DataFrame, right: DataFrame, token: str, key: str | None = None) -> DataFrame:
    """Tokens that one side holds more often: missing (left over right) and extra."""
    keys = [key, token] if key else [token]
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, keys, "full_outer").na.fill(0, ["na", "nb"])
    return both.select(*keys, F.greatest(F.col("na") - F.col("nb"), F.lit(0)).alias("missing"), F.greatest(F.col("nb") - F.col("na"), F.lit(0)).alias("extra"))


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fails where a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("__n", n)
    return checked.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"repeated key in {keys}"))).otherwise(F.col("__n"))).where("__n = 1").drop("__n")


def enforced_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails where the right side has no row."""
    marked = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    missing = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean"))
    return marked.where(F.coalesce(missing, F.lit(True))).drop("__there")
