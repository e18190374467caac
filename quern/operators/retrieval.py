"""Vector search, rank fusion, diversification, voting and the authority catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

RRF_K = 60
#: Queries that one mapper holds; more take several mappers in a row.
QUERY_BLOCK = 1024
#: Products of queries and rows that a mapper holds at a time.
PRODUCTS = 1 << 19


def dot(a: str, b: str) -> Column:
    """In double, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, row_id, sim, rank): each query's k nearest rows by dot product, ties by row id.

    Queries are a stated set, read in blocks of QUERY_BLOCK; each block is shipped to mappers that stream the
    corpus, multiply batch by batch and keep a task's k best per query, so k rows per query and task are
    shuffled. The exact products of those survivors are summed in double by the caller's engine order.
    """
    rows = queries.select(query_id, vector).orderBy(query_id).toLocalIterator()
    out, held = None, []

    def part(held: list) -> DataFrame:
        ids = [r[0] for r in held]
        matrix = np.array([r[1] for r in held], np.float64)
        return corpus.select(row_id, vector).mapInArrow(_nearest(ids, matrix, k), f"{query_id} {_type(queries, query_id)}, {row_id} {_type(corpus, row_id)}, sim double")

    for r in rows:
        held.append(r)
        if len(held) == block:
            out, held = (part(held) if out is None else out.union(part(held))), []
    if held or out is None:
        last = part(held) if held else corpus.select(F.lit(None).cast(_type(queries, query_id)).alias(query_id), row_id, F.lit(0.0).alias("sim")).limit(0)
        out = last if out is None else out.union(last)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("sim"), row_id))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _nearest(ids: list, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] | None = None
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            flat = np.asarray(batch.column(1).flatten(), np.float64)
            if not len(flat):
                continue
            all_rows, all_names = flat.reshape(batch.num_rows, -1), np.asarray(batch.column(0))
            step = max(1, PRODUCTS // max(1, len(ids)))
            for low in range(0, len(all_rows), step):
                rows, names = np.ascontiguousarray(all_rows[low : low + step].T), all_names[low : low + step]
                # products are added in the order of the dimensions, as a plain sum would
                sims = np.zeros((len(ids), len(names)))
                for d in range(matrix.shape[1]):
                    sims += matrix[:, d : d + 1] * rows[d]
                best = best or [(np.zeros(0), names[:0])] * len(ids)
                for q, (s, n) in enumerate(best):
                    # a row below the k-th best so far cannot be among them
                    near = sims[q] >= s[-1] if len(s) == k else np.ones(len(names), bool)
                    if near.any():
                        s, n = np.concatenate([s, sims[q][near]]), np.concatenate([n, names[near]])
                        order = np.lexsort((n, -s))[:k]
                        best[q] = s[order], n[order]
        if best:
            for q, (s, n) in enumerate(best):
                yield pa.record_batch([pa.array([ids[q]] * len(s)), pa.array(n, kind), pa.array(s)], names=["q", "r", "sim"])

    return run


def reciprocal_ranks(hits: DataFrame, row: str, rank: str = "rank", weight: str | None = None, sim: str = "sim", query: str = "query_id", pool: int = 40) -> DataFrame:
    """(row, fused, best_similarity, query_hits): sums of weight / (60 + rank), the best `pool`."""
    w = F.col(weight) if weight else F.lit(1.0)
    fused = hits.groupBy(row).agg(F.sum(w / (RRF_K + F.col(rank))).alias("fused"), F.max(sim).alias("best_similarity"), F.countDistinct(query).alias("query_hits"))
    return fused.orderBy(F.round("fused", 9).desc(), F.round("best_similarity", 9).desc(), row).limit(pool)


def max_plus(hits: DataFrame, row: str, sim: str = "sim") -> DataFrame:
    """Best similarity and 0.03 for every further hit."""
    n = F.count(F.lit(1))
    return hits.groupBy(row).agg((F.max(sim) + 0.03 * (n - 1)).alias("score"), F.avg(sim).alias("average"), n.alias("hits"))


def restricted_search(rows: DataFrame, queries: DataFrame, act: str, row: str, top: int = 8, bonus: float = 0.04) -> DataFrame:
    """Rows of an act against the act's queries; a row counts by its best query; its bonus decays with the rank."""
    met = rows.join(queries.withColumnRenamed("vec", "qvec"), act).select(act, row, dot("vec", "qvec").alias("sim"))
    best = met.groupBy(act, row).agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy(act).orderBy(F.desc("sim"), row))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("bonus", F.lit(bonus) / (1.0 + 0.15 * (F.col("rank") - 1)))


def fuse_seeds(contributions: DataFrame, row: str) -> DataFrame:
    """(row, fused, best_similarity, seed_bonus, heading_score, hits) from (row, kind, label, value, sim, heading) contributions."""
    seed = F.col("kind") != "query"
    return contributions.groupBy(row).agg(
        F.sum("value").alias("fused"), F.max("sim").alias("best_similarity"), F.coalesce(F.max(F.when(seed, F.col("value"))), F.lit(0.0)).alias("seed_bonus"),
        F.coalesce(F.max("heading"), F.lit(0.0)).alias("heading_score"), F.countDistinct("label").alias("hits"),
    )


def scenario_fusion(best: DataFrame, scenario: str, query: str, sim: str, limit: int = 14) -> DataFrame:
    """From the best similarity of each (scenario, query), query 0 being the original."""
    original = F.max(F.when(F.col(query) == 0, F.col(sim)))
    grouped = best.groupBy(scenario).agg(original.alias("original"), F.max(sim).alias("best"), F.countDistinct(query).alias("queries"))
    more = F.col("queries") - 1
    with_original = F.col("original") + F.least(F.greatest(F.lit(0.0), F.col("best") - F.col("original")), F.lit(0.025)) + F.least(0.004 * more, F.lit(0.012))
    without = F.col("best") - 0.035 + F.least(0.004 * more, F.lit(0.008))
    scored = grouped.withColumn("score", F.when(F.col("original").isNotNull(), with_original).otherwise(without))
    return scored.orderBy(F.round("score", 9).desc(), scenario).limit(limit)


def one_per_document(ranked: DataFrame, document: str, order: list, limit: int) -> DataFrame:
    """W04"""
    first = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where("__n = 1").drop("__n")
    return first.orderBy(*order).limit(limit)


def capped(ranked: DataFrame, document: str, condition: Column, most: int, order: list, limit: int) -> DataFrame:
    """At most `most` rows of a document where the condition holds."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return ranked.withColumn("__n", n).where(~condition | (F.col("__n") <= most)).drop("__n").orderBy(*order).limit(limit)


def quotas(ranked: DataFrame, document: str, kind: str, limits: dict[str, int], other: int, order: list, limit: int) -> DataFrame:
    """One row per document, then the first rows of each type up to its quota, then `limit`."""
    once = ranked.withColumn("__d", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where("__d = 1")
    quota = F.lit(other)
    for name, most in limits.items():
        quota = F.when(F.col(kind) == name, most).otherwise(quota)
    per = once.withColumn("__t", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__t") <= quota)
    return per.drop("__d", "__t").orderBy(*order).limit(limit)


def scenario_votes(hits: DataFrame, scenario: str, chunk: str, sim: str, rank: str, limit: int = 10) -> DataFrame:
    """Per scenario its best hit, count of hits and the best hit's chunk and rank."""
    best = F.max(F.struct(F.col(sim), (-F.col(chunk)).alias("m"), F.col(rank).alias("r")))
    grouped = hits.groupBy(scenario).agg(best.alias("b"), F.count(F.lit(1)).alias("n_chunks"))
    out = grouped.select(scenario, F.col(f"b.{sim}").alias("best_similarity"), "n_chunks", (-F.col("b.m")).alias("best_chunk"), F.col("b.r").alias("best_rank"))
    return out.orderBy(F.round("best_similarity", 9).desc(), scenario).limit(limit)


def label_votes(scenarios: DataFrame, labels: str, score: str, key: str, limit: int | None = None) -> DataFrame:
    """Per label its votes, sum and maximum of the score, and the supporters."""
    each = scenarios.select(key, F.col(score).alias("s"), F.explode(labels).alias("label"))
    votes = each.groupBy("label").agg(F.count(F.lit(1)).alias("votes"), F.sum("s").alias("score_sum"), F.max("s").alias("score_max"), F.array_sort(F.collect_set(key)).alias("supporters"))
    ordered = votes.orderBy(F.desc("votes"), F.round("score_sum", 9).desc(), F.round("score_max", 9).desc(), "label")
    return ordered.limit(limit) if limit else ordered


# ---- authority catalogue


def act_catalogue(rows: DataFrame, title: str, section: str, heading: str, row: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acts, sections, headings): inverted tables of act, (act, section) and (act, heading) to rows."""
    keyed = rows.select(T.act_key(title).alias("act_key"), F.col(title).alias("title"), T.section_key(section).alias("section_key"), T.match_text(heading).alias("heading_key"), F.col(row).alias("row")).where("act_key <> ''")
    acts = keyed.groupBy("act_key").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_rows"), F.min("row").alias("first_row"))
    sections = keyed.where("section_key <> ''").select("act_key", "section_key", "row").distinct()
    headings = keyed.where("heading_key <> ''").select("act_key", "heading_key", "row").distinct()
    return acts, sections, headings


def section_lookup(targets: DataFrame, sections: DataFrame) -> DataFrame:
    """(act_key, section_key) targets with their rows; one without rows is invalid."""
    found = sections.groupBy("act_key", "section_key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row").alias("first_row"))
    return targets.join(found, ["act_key", "section_key"], "left").withColumn("valid", F.col("n_rows").isNotNull())


def heading_score(concept: Column, heading: Column) -> Column:
    """Of one concept and a heading, both as match text."""
    c, h = T.retrieval_terms(concept), T.retrieval_terms(heading)
    shared = F.size(F.array_intersect(c, h))
    phrase = F.when((concept != "") & F.contains(heading, concept), 0.6).when((heading != "") & F.contains(concept, heading), 0.35).otherwise(0.0)
    score = 0.65 * shared / F.greatest(F.size(c), F.lit(1)) + 0.25 * shared / F.greatest(F.size(h), F.lit(1)) + phrase
    return F.when((F.size(c) > 0) & (F.size(h) > 0), score).otherwise(0.0)


def heading_seeds(concepts: DataFrame, headings: DataFrame, least: float = 0.18, most: int = 8) -> DataFrame:
    """Per act its rows whose heading meets one of the act's concepts, the best `most`."""
    met = concepts.select("act_key", T.match_text("concept").alias("c")).join(headings, "act_key")
    scored = met.withColumn("score", F.least(F.lit(1.0), heading_score(F.col("c"), F.col("heading_key"))))
    best = scored.groupBy("act_key", "row").agg(F.max(F.struct("score", "heading_key")).alias("b")).select("act_key", "row", F.col("b.score").alias("score"), F.col("b.heading_key").alias("heading"))
    rank = F.row_number().over(Window.partitionBy("act_key").orderBy(F.round("score", 9).desc(), F.desc("row")))
    return best.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def evidence_bonus(rule: str, candidate: str) -> Column:
    """0.08 for the share of the rule's terms that the candidate holds."""
    r, c = T.retrieval_terms(rule), T.retrieval_terms(candidate)
    return F.when(F.size(r) > 0, 0.08 * F.size(F.array_intersect(r, c)) / F.size(r)).otherwise(0.0)


def sequence_ratio(pairs: DataFrame, left: str, right: str, out: str = "ratio") -> DataFrame:
    """Adds the Ratcliff-Obershelp ratio of two strings."""

    @F.pandas_udf("double")
    def ratio(a, b):
        from difflib import SequenceMatcher

        return a.combine(b, lambda x, y: SequenceMatcher(None, x or "", y or "").ratio()).astype("float64")

    return pairs.withColumn(out, ratio(left, right))


#: Token sets of a group that one task meets with another such block of it, and keys that one row of a set lists.
SET_BLOCK, KEY_LIST = 2048, 1024


def jaccard_pairs(rows: DataFrame, key: str, group: list[str], tokens: str) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b of a group; `tokens` are sorted arrays of distinct tokens.

    Every pair is listed, so rows grow with the square of a group. Each two different token sets of a group are compared once,
    and the pairs of their rows unfolded from lists. Sets meet in blocks that tasks share: the bytes of a table say nothing about
    its number of pairs, so they must not decide on the tasks.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = rows.na.drop(subset=[key, *group])
    sizes = found.groupBy(*group, tokens).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.ceil(F.sum(F.ceil(F.col("n") / KEY_LIST)) / SET_BLOCK).cast("int").alias("blocks"), F.ceil(F.max("n") / KEY_LIST).alias("lists"))
    dealt = found.join(sizes, group).withColumn("list", F.pmod(F.xxhash64(key), F.col("lists")))
    sets = dealt.groupBy(*group, F.col(tokens).alias("w"), "list", "blocks").agg(F.collect_list(key).alias("keys"))
    sets = sets.withColumns({"block": F.pmod(F.xxhash64("w", "list"), F.col("blocks")).cast("int"), "every": F.sequence(F.lit(0), F.col("blocks") - 1)})
    side = lambda n, own, other: sets.select(*group, F.col("block").alias(own), F.explode("every").alias(other), *(F.col(c).alias(f"{c}_{n}") for c in ("w", "list", "keys"))).repartition(tasks, *group, "x", "y")
    met = side("x", "x", "y").join(side("y", "y", "x"), [*group, "x", "y"])
    one, other = (F.struct(F.col("x").alias("p") if n == "x" else F.col("y").alias("p"), F.col(f"list_{n}").alias("q"), F.col(f"w_{n}").alias("r")) for n in "xy")
    shared = F.size(F.array_intersect("w_x", "w_y"))
    both = F.size("w_x") + F.size("w_y") - shared
    scored = met.where(one <= other).select((one == other).alias("same"), "keys_x", "keys_y", F.when(both > 0, shared / both).otherwise(F.lit(0.0)).alias("jaccard"))
    unfolded = scored.select("same", "jaccard", "keys_y", F.explode("keys_x").alias("i")).select("same", "jaccard", "i", F.explode("keys_y").alias("j"))
    return unfolded.where("i < j or (i > j and not same)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")


def match_hints(hints: DataFrame, acts: DataFrame, hint_id: str, hint: str, least: float = 0.82) -> DataFrame:
    """(hint_id, act_key, score): the exact key first; else the best of 0.60 Jaccard and 0.40 sequence, years agreeing.

    Only acts that share a token with the hint can reach the threshold (a sequence ratio alone gives 0.40), so the
    fuzzy part is an equi-join on tokens.
    """
    keyed = hints.select(hint_id, T.act_key(T.act_of_hint(hint)).alias("hint_key")).where("hint_key <> ''")
    exact = keyed.join(acts.select("act_key"), F.col("hint_key") == F.col("act_key")).select(hint_id, "act_key", F.lit(1.0).alias("score"))
    rest = keyed.join(exact, hint_id, "left_anti")
    tokens = lambda df, c: df.withColumn("t", F.explode(F.array_distinct(F.split(c, " "))))
    met = tokens(rest, "hint_key").join(tokens(acts.select("act_key"), "act_key"), "t").select(hint_id, "hint_key", "act_key").distinct()
    years = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b"), F.lit(1)))
    agree = met.where((F.size(years("hint_key")) == 0) | (F.size(years("act_key")) == 0) | (F.array_sort(years("hint_key")) == F.array_sort(years("act_key"))))
    a, b = F.array_distinct(F.split("hint_key", " ")), F.array_distinct(F.split("act_key", " "))
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    # 0.6 j + 0.4 reaches the threshold only from this overlap on
    near = agree.withColumn("jaccard", jaccard).where(F.col("jaccard") >= (least - 0.4) / 0.6)
    scored = sequence_ratio(near, "hint_key", "act_key").withColumn("score", 0.6 * F.col("jaccard") + 0.4 * F.col("ratio")).where(F.col("score") >= least)
    best = scored.groupBy(hint_id).agg(F.max_by("act_key", F.struct("score", "act_key")).alias("act_key"), F.max("score").alias("score"))
    return exact.union(best.select(hint_id, "act_key", "score"))


def upsert_queries(queries: DataFrame, text: str, act: str, weight: str, most: int = 24) -> DataFrame:
    """One row per (lower-case text, act), with the heaviest weight; the first `most`."""
    key = [F.lower(T.collapse(text)).alias("key"), F.coalesce(act, F.lit("")).alias("act_key")]
    kept = queries.groupBy(*key).agg(F.max(weight).alias("weight"), F.min("ord").alias("ord"))
    return kept.orderBy("ord", "key", "act_key").limit(most)


def ordered_distinct(df: DataFrame, group: str, text: str, order: str, most: int) -> DataFrame:
    """Per group the first row of each text, ignoring case, up to `most`."""
    key = F.lower(T.collapse(text))
    first = df.withColumn("k", key).where("k <> ''").withColumn("n", F.row_number().over(Window.partitionBy(group, "k").orderBy(order))).where("n = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("position") <= most).drop("k", "n")


def priority_union(first: DataFrame, second: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first table's rows come before the second's; one per key; up to `most`."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("side", order))).where("n = 1").drop("n")
    return once.orderBy("side", order).limit(most)


def evenly_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """N rows at even distances in key order.

    Rows are range-partitioned by key and numbered by (partition, place), so no task sorts the whole table.
    """
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("p", F.spark_partition_id())
    numbered = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1)
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("m")).withColumn("first", F.sum("m").over(Window.orderBy("p")) - F.col("m")).withColumn("all", F.sum("m").over(Window.partitionBy()))
    at = numbered.join(sizes, "p").withColumn("at", F.col("i") + F.col("first"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("all") - 1) / (n - 1)))
    return at.where(F.array_contains(wanted, F.col("at"))).select(*df.columns)


# ---- encoders


def hashing_encoder(docs: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """Unit vectors from signed word hashes; stands in where no model is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for text_ in batch.column(1).to_pylist():
                v = np.zeros(dimensions)
                for w in (text_ or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dimensions] += 1.0 if h >> 63 else -1.0
                length = np.linalg.norm(v)
                out.append((v / length if length else v).astype(np.float32).tolist())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["k", "vec"])

    return docs.select(key, text).mapInArrow(run, f"{key} {_type(docs, key)}, vec array<float>")
