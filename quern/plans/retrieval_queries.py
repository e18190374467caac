"""Queries of search, fusion, diversification, votes and the authority catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import sketch as S
from quern.functions import text as T
from quern.operators import link as L
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.plans.text_queries import dup_sql, match_sql

#: Every hundredth vector is a query, against all vectors.
IS_QUERY, K = "vec_id % 100 = 0", 30
HITS = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS row_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
  FROM embeddings q, embeddings c WHERE q.{IS_QUERY})"""
TOP = f"SELECT * FROM ({HITS}) WHERE rank <= {K}"


def hits(t, k: int = K):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return R.top_k(e.where(IS_QUERY).withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "row_id"), k)


@query("vec_topk", f"SELECT query_id, row_id, round(sim, 9) AS sim, rank::INTEGER AS rank FROM ({TOP})")
def vec_topk(t):
    """J06, X33, W01, T01"""
    return hits(t).select("query_id", "row_id", F.round("sim", 9).alias("sim"), "rank")


@query("vec_topk_blocks", "SELECT query_id, row_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS row_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)) WHERE rank <= 8")
def vec_topk_blocks(t):
    """Every hundredth vector as a query, in blocks; each finds itself first."""
    e = t("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return R.top_k(queries, e.withColumnRenamed("vec_id", "row_id"), 8, block=64).select("query_id", "row_id", "rank")


@query("vector_norms", "SELECT count(*) AS n, round(avg(l), 6) AS mean, round(min(l), 6) AS low, round(max(l), 6) AS high, count(*) FILTER (isnan(l)) AS not_finite FROM (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)")
def vector_norms(t):
    """A25"""
    own = t("embeddings").select(R.norm("embedding").alias("l"))
    r6 = lambda f, n: F.round(f("l"), 6).alias(n)
    return own.agg(F.count(F.lit(1)).alias("n"), r6(F.avg, "mean"), r6(F.min, "low"), r6(F.max, "high"), F.count_if(F.isnan("l")).alias("not_finite"))


@query("spaced_sample", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) WHERE i IN (SELECT floor(k * (n - 1) / 19)::BIGINT FROM range(20) r(k))")
def spaced_sample(t):
    """Twenty vectors at even distances in the order of their ids."""
    return R.evenly_spaced(t("embeddings").select("vec_id"), "vec_id", 20)


FUSED = f"SELECT row_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(sim) AS best_similarity, count(DISTINCT query_id) AS query_hits FROM ({TOP}) GROUP BY row_id ORDER BY round(fused, 9) DESC, round(best_similarity, 9) DESC, row_id LIMIT 40"


@query("rrf_fusion", f"SELECT row_id, round(fused, 8) AS fused, round(best_similarity, 8) AS best_similarity, query_hits FROM ({FUSED})")
def rrf_fusion(t):
    """A14"""
    return R.reciprocal_ranks(hits(t), "row_id").select("row_id", F.round("fused", 8).alias("fused"), F.round("best_similarity", 8).alias("best_similarity"), "query_hits")


@query("weighted_rrf", f"SELECT row_id, round(fused, 8) AS fused, query_hits FROM (SELECT row_id, sum((1 + query_id / 1000) / (60 + rank)) AS fused, max(sim) AS b, count(DISTINCT query_id) AS query_hits FROM ({TOP}) GROUP BY row_id ORDER BY round(fused, 9) DESC, round(b, 9) DESC, row_id LIMIT 70)")
def weighted_rrf(t):
    """A15"""
    weighted = hits(t).withColumn("w", 1 + F.col("query_id") / 1000)
    return R.reciprocal_ranks(weighted, "row_id", weight="w", pool=70).select("row_id", F.round("fused", 8).alias("fused"), "query_hits")


@query("maxplus_fusion", f"SELECT row_id, round(max(sim) + 0.03::DOUBLE * (count(*) - 1), 8) AS score, round(avg(sim), 8) AS average, count(*) AS hits FROM ({TOP}) GROUP BY row_id")
def maxplus_fusion(t):
    """A16"""
    return R.max_plus(hits(t), "row_id").select("row_id", F.round("score", 8).alias("score"), F.round("average", 8).alias("average"), "hits")


RESTRICTED = f"""SELECT *, 0.04::DOUBLE / (1 + 0.15::DOUBLE * (rank - 1)) AS bonus FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, row_id) AS rank FROM (SELECT c.label, c.vec_id AS row_id, max(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS sim
  FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.{IS_QUERY} GROUP BY ALL)) WHERE rank <= 8"""


def _restricted(t):
    e = t("embeddings")
    rows = e.select("label", F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return R.restricted_search(rows, e.where(IS_QUERY).select("label", F.col("embedding").alias("vec")), "label", "row_id")


@query("restricted_search", f"SELECT label, row_id, round(sim, 8) AS sim, rank::INTEGER AS rank, round(bonus, 8) AS bonus FROM ({RESTRICTED})")
def restricted_search(t):
    """J07, W12"""
    return _restricted(t).select("label", "row_id", F.round("sim", 8).alias("sim"), "rank", F.round("bonus", 8).alias("bonus"))


@query(
    "seed_bonus",
    f"""WITH c AS (SELECT row_id, 'query' AS kind, 'q' || query_id AS label, 1.0::DOUBLE / (60 + rank) AS value, sim, 0.0::DOUBLE AS heading FROM ({TOP}) UNION ALL SELECT row_id, 'restricted', 'authority:' || label, bonus, sim, 0 FROM ({RESTRICTED})
        UNION ALL SELECT vec_id, 'heading', 'heading:' || label, 0.055::DOUBLE * 0.5, NULL, 0.5 FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id, 'exact', 'exact:' || label, 0.07::DOUBLE, NULL, 0 FROM embeddings WHERE label = 7)
      SELECT row_id, round(sum(value), 8) AS fused, round(max(sim), 8) AS best_similarity, round(coalesce(max(value) FILTER (kind <> 'query'), 0), 8) AS seed_bonus, round(coalesce(max(heading), 0), 8) AS heading_score, count(DISTINCT label) AS hits FROM c GROUP BY row_id""",
)
def seed_bonus(t):
    """Queries, restricted, heading and exact seeds in one sum."""
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    e = t("embeddings")

    def rows(df, row, kind, label, value, sim, heading):
        return df.select(F.col(row).alias("row_id"), F.lit(kind).alias("kind"), label.alias("label"), value.alias("value"), sim.alias("sim"), heading.alias("heading"))

    parts = rows(hits(t), "row_id", "query", F.concat(F.lit("q"), "query_id"), 1.0 / (R.RRF_K + F.col("rank")), F.col("sim"), zero)
    parts = parts.union(rows(_restricted(t), "row_id", "restricted", F.concat(F.lit("authority:"), "label"), F.col("bonus"), F.col("sim"), zero))
    parts = parts.union(rows(e.where("label = 3"), "vec_id", "heading", F.concat(F.lit("heading:"), "label"), F.lit(0.055 * 0.5), none, F.lit(0.5)))
    parts = parts.union(rows(e.where("label = 7"), "vec_id", "exact", F.concat(F.lit("exact:"), "label"), F.lit(0.07), none, zero))
    r8 = lambda c: F.round(c, 8).alias(c)
    return R.fuse_seeds(parts, "row_id").select("row_id", r8("fused"), r8("best_similarity"), r8("seed_bonus"), r8("heading_score"), "hits")


BEST = f"SELECT row_id % 50 AS scenario_id, query_id, max(sim) AS sim FROM ({TOP}) GROUP BY ALL"


@query(
    "scenario_fusion",
    f"""SELECT scenario_id, round(score, 8) AS score, queries FROM (SELECT *, CASE WHEN original IS NOT NULL THEN original + least(greatest(0, best - original), 0.025::DOUBLE) + least(0.004::DOUBLE * (queries - 1), 0.012::DOUBLE)
        ELSE best - 0.035::DOUBLE + least(0.004::DOUBLE * (queries - 1), 0.008::DOUBLE) END AS score FROM (SELECT scenario_id, max(sim) FILTER (query_id = 0) AS original, max(sim) AS best, count(DISTINCT query_id) AS queries FROM ({BEST}) GROUP BY 1))
      ORDER BY round(score, 9) DESC, scenario_id LIMIT 14""",
)
def scenario_fusion(t):
    """W02, A17, J01"""
    best = hits(t).groupBy((F.col("row_id") % 50).alias("scenario_id"), "query_id").agg(F.max("sim").alias("sim"))
    return R.scenario_fusion(best, "scenario_id", "query_id", "sim").select("scenario_id", F.round("score", 8).alias("score"), "queries")


RANKED = f"SELECT *, row_id % 20 AS document, CASE row_id % 20 % 4 WHEN 0 THEN 'supreme_court' WHEN 1 THEN 'central_act' WHEN 2 THEN 'constitution' ELSE 'unknown' END AS source_type FROM ({FUSED})"


def _ranked(t):
    kind = F.element_at(F.array(*map(F.lit, ("supreme_court", "central_act", "constitution", "unknown"))), (F.col("row_id") % 20 % 4 + 1).cast("int"))
    return R.reciprocal_ranks(hits(t), "row_id").withColumns({"document": F.col("row_id") % 20, "source_type": kind})


ORDER_SQL = "round(fused, 9) DESC, round(best_similarity, 9) DESC, row_id"


def _order():
    return [F.round("fused", 9).desc(), F.round("best_similarity", 9).desc(), F.col("row_id")]


@query("diversify_doc", f"SELECT row_id, document FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY {ORDER_SQL}) AS n FROM ({RANKED})) WHERE n = 1 ORDER BY {ORDER_SQL} LIMIT 12")
def diversify_doc(t):
    """W04"""
    return R.one_per_document(_ranked(t), "document", _order(), 12).select("row_id", "document")


@query("diversify_cap2", f"SELECT row_id, document FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY {ORDER_SQL}) AS n FROM ({RANKED})) WHERE source_type <> 'supreme_court' OR n <= 2 ORDER BY {ORDER_SQL} LIMIT 6")
def diversify_cap2(t):
    """W05"""
    return R.capped(_ranked(t), "document", F.col("source_type") == "supreme_court", 2, _order(), 6).select("row_id", "document")


QUOTAS = {"supreme_court": 6, "central_act": 8, "constitution": 4}


@query(
    "diversify_quota",
    f"""SELECT row_id, document, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY {ORDER_SQL}) AS k FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY {ORDER_SQL}) AS n FROM ({RANKED})) WHERE n = 1)
      WHERE k <= CASE source_type WHEN 'supreme_court' THEN 6 WHEN 'central_act' THEN 8 WHEN 'constitution' THEN 4 ELSE 5 END ORDER BY {ORDER_SQL} LIMIT 8""",
)
def diversify_quota(t):
    """W06"""
    return R.quotas(_ranked(t), "document", "source_type", QUOTAS, 5, _order(), 8).select("row_id", "document", "source_type")


@query(
    "scenario_agg",
    f"SELECT scenario_id, round(max(sim), 8) AS best_similarity, count(*) AS n_chunks, arg_max(row_id, (sim, -row_id)) AS best_chunk, arg_max(rank, (sim, -row_id))::INTEGER AS best_rank FROM (SELECT *, row_id % 50 AS scenario_id FROM ({HITS}) WHERE query_id = 0 AND rank <= 60) GROUP BY 1 ORDER BY round(max(sim), 9) DESC, scenario_id LIMIT 10",
)
def scenario_agg(t):
    """A11"""
    top = hits(t, 60).where("query_id = 0").withColumn("scenario_id", F.col("row_id") % 50)
    return R.scenario_votes(top, "scenario_id", "row_id", "sim", "rank").withColumn("best_similarity", F.round("best_similarity", 8))


@query(
    "statute_votes",
    f"SELECT label, count(*) AS votes, round(sum(sim), 8) AS score_sum, round(max(sim), 8) AS score_max, string_agg(DISTINCT row_id::VARCHAR, ',' ORDER BY row_id::VARCHAR) AS supporters FROM (SELECT h.row_id, h.sim, unnest(['law' || e.label, 'law' || (e.label + 1) % 10]) AS label FROM ({TOP}) h JOIN embeddings e ON h.row_id = e.vec_id WHERE query_id = 0) GROUP BY label",
)
def statute_votes(t):
    """A12, A28"""
    laws = F.array(F.concat(F.lit("law"), "label"), F.concat(F.lit("law"), (F.col("label") + 1) % 10))
    top = hits(t).where("query_id = 0").join(t("embeddings").select(F.col("vec_id").alias("row_id"), laws.alias("laws")), "row_id")
    votes = R.label_votes(top, "laws", "sim", "row_id")
    ids = F.array_join(F.array_sort(F.transform("supporters", lambda i: i.cast("string"))), ",")
    return votes.select("label", "votes", F.round("score_sum", 8).alias("score_sum"), F.round("score_max", 8).alias("score_max"), ids.alias("supporters"))


@query(
    "law_votes",
    f"SELECT label, count(*) AS votes, round(sum(s), 8) AS score_sum FROM (SELECT 'law' || e.label AS label, 2 + sim AS s FROM ({TOP}) h JOIN embeddings e ON h.row_id = e.vec_id WHERE query_id = 100) GROUP BY label ORDER BY votes DESC, round(sum(s), 9) DESC, round(max(s), 9) DESC, label LIMIT 10",
)
def law_votes(t):
    """A13"""
    top = hits(t).where("query_id = 100").join(t("embeddings").select(F.col("vec_id").alias("row_id"), F.array(F.concat(F.lit("law"), "label")).alias("laws")), "row_id")
    return R.label_votes(top.withColumn("s", 2 + F.col("sim")), "laws", "s", "row_id", 10).select("label", "votes", F.round("score_sum", 8).alias("score_sum"))


ACT_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), '\\bthe\\b', ' ', 'g'), ' +', ' ', 'g'))"
KEYED = f"SELECT {ACT_KEY.format('p_type')} AS act_key, p_type AS title, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS section_key, {match_sql('p_name')} AS heading_key, p_partkey AS row FROM part"


def _catalogue(t):
    return R.act_catalogue(t("part"), "p_type", "p_brand", "p_name", "p_partkey")


@query("act_catalog", f"SELECT act_key, min(title) AS title, count(*) AS n_rows, min(row) AS first_row FROM ({KEYED}) GROUP BY act_key")
def act_catalog(t):
    """S13"""
    return _catalogue(t)[0]


@query(
    "section_lookup",
    f"""WITH s AS (SELECT act_key, section_key, count(DISTINCT row) AS n_rows, min(row) AS first_row FROM ({KEYED}) GROUP BY ALL), targets AS (SELECT DISTINCT {ACT_KEY.format('p_type')} AS act_key, 'brand ' || p_size AS section_key FROM part)
      SELECT act_key, section_key, n_rows, first_row, n_rows IS NOT NULL AS valid FROM targets LEFT JOIN s USING (act_key, section_key)""",
)
def section_lookup(t):
    """J18"""
    targets = t("part").select(T.act_key("p_type").alias("act_key"), T.section_key(F.concat(F.lit("Brand#"), "p_size")).alias("section_key")).distinct()
    return R.section_lookup(targets, _catalogue(t)[1])


TERMS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.RETRIEVAL_STOP) + "], w))"
HEADING = f"""WITH headings AS (SELECT DISTINCT act_key, heading_key, row FROM ({KEYED})), concepts AS (SELECT act_key, {match_sql('c')} AS c FROM (SELECT {ACT_KEY.format('p_type')} AS act_key, min(p_name) AS c FROM part GROUP BY 1)),
  met AS (SELECT act_key, row, heading_key, c, {TERMS.format('c')} AS ct, {TERMS.format('heading_key')} AS ht FROM concepts JOIN headings USING (act_key)),
  scored AS (SELECT act_key, row, heading_key, CASE WHEN len(ct) > 0 AND len(ht) > 0 THEN least(1.0::DOUBLE, 0.65::DOUBLE * len(list_intersect(ct, ht)) / len(ct) + 0.25::DOUBLE * len(list_intersect(ct, ht)) / len(ht) + CASE WHEN contains(heading_key, c) THEN 0.6::DOUBLE WHEN contains(c, heading_key) THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0 END AS score FROM met)"""


@query("heading_scores", f"{HEADING} SELECT act_key, row, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY act_key ORDER BY round(score, 9) DESC, row DESC) AS rank FROM scored WHERE score >= 0.18) WHERE rank <= 8")
def heading_scores(t):
    """X14, F08"""
    concepts = t("part").groupBy(T.act_key("p_type").alias("act_key")).agg(F.min("p_name").alias("concept"))
    return R.heading_seeds(concepts, _catalogue(t)[2]).select("act_key", "row", F.round("score", 6).alias("score"), "rank")


@query("fuzzy_act_match", None)
def fuzzy_act_match(t):
    """Hints are part types with a word changed."""
    hints = t("part").select("p_partkey", F.concat(F.lit("The "), F.regexp_replace("p_type", "E", "EE"), F.lit(", section 5")).alias("hint"))
    return R.match_hints(hints, _catalogue(t)[0], "p_partkey", "hint")


TITLE_TERMS = f"string_split(trim(regexp_replace({dup_sql('p_name')}, '[^a-z0-9 ]+', ' ', 'g')), ' ')"


@query(
    "title_jaccard",
    f"SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM (SELECT p.p_partkey AS a, q.p_partkey AS b, p.w AS x, q.w AS y FROM (SELECT *, {TITLE_TERMS} AS w FROM part) p JOIN (SELECT *, {TITLE_TERMS} AS w FROM part) q ON p.p_brand = q.p_brand AND p.p_size = q.p_size AND p.p_partkey < q.p_partkey)",
)
def title_jaccard(t):
    """X12, U04"""
    own = t("part").select("p_partkey", "p_brand", "p_size", F.array_sort(F.array_distinct(F.split(T.title_key("p_name"), " "))).alias("w"))
    return R.jaccard_pairs(own, "p_partkey", ["p_brand", "p_size"], "w").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    "link_best_match",
    """SELECT o_orderkey, s_suppkey, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'NO_MATCH' WHEN score >= 0.85 THEN 'HIGH_CONFIDENCE' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'LOW_CONFIDENCE' END AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC NULLS LAST, s_suppkey) AS n FROM (SELECT o_orderkey, s_suppkey, 1 - levenshtein(replace(c_name, 'Customer', 'Supplier'), s_name) / greatest(length(c_name), length(s_name)) AS score
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON c_nationkey = s_nationkey)) WHERE n = 1""",
)
def link_best_match(t):
    """An equi-join, then the most similar name; edit distance in place of the sequence ratio."""
    called = F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))
    own = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "c_name", called.alias("called"))
    asked = t("customer").select(F.col("c_nationkey").alias("nation"), called.alias("called")).where("nation is not null and called is not null")
    suppliers = t("supplier").where("s_nationkey is not null")
    nearest = L.nearest_name(asked, suppliers, "nation", "called", "s_nationkey", "s_name", "s_suppkey")
    met = own.join(nearest, (F.col("c_nationkey") == F.col("group")) & (own["called"] == F.col("first")), "left")
    # without a name on either side no score can be told, and the first supplier of the nation stands
    any_of = suppliers.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("any"))
    met = met.join(F.broadcast(any_of), F.col("c_nationkey") == F.col("s_nationkey"), "left").withColumn("s_suppkey", F.coalesce("least", "any"))
    score = 1 - F.col("edits") / F.greatest(F.length("c_name"), F.length("name"))
    best = met.select("o_orderkey", "s_suppkey", score.alias("score")).groupBy("o_orderkey").agg(F.max(F.struct("score", (-F.col("s_suppkey")).alias("m"))).alias("b"))
    s = F.col("b.score")
    status = F.when(s.isNull(), "NO_MATCH").when(s >= 0.85, "HIGH_CONFIDENCE").when(s >= 0.65, "REVIEW").otherwise("LOW_CONFIDENCE")
    return best.select("o_orderkey", (-F.col("b.m")).alias("s_suppkey"), F.round(s, 6).alias("score"), status.alias("status"))


@query("query_union", "SELECT conv_id, turn, position::INTEGER AS position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY turn) AS n FROM conversations) WHERE n = 1 AND trim(text) <> '') WHERE position <= 4")
def query_union(t):
    """U02, T06"""
    return R.ordered_distinct(t("conversations"), "conv_id", "text", "turn", 4).select("conv_id", "turn", "position")


@query("query_upsert", "SELECT key, act_key, weight, ord FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, role AS act_key, max(turn / 10) AS weight, min(conv_id * 100 + turn) AS ord FROM conversations GROUP BY 1, 2) ORDER BY ord, key, act_key LIMIT 24")
def query_upsert(t):
    """U03, T06"""
    rows = t("conversations").withColumns({"weight": F.col("turn") / 10, "ord": F.col("conv_id") * 100 + F.col("turn")})
    return R.upsert_queries(rows, "text", "role", "weight")


@query("priority_union", "SELECT doc_id, source, side FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY side, doc_id) AS n FROM (SELECT doc_id, source, 0 AS side FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id, source, 1 FROM documents)) WHERE n = 1 ORDER BY side, doc_id LIMIT 6")
def priority_union(t):
    """The first six sources, those of toxic documents before the rest."""
    d = t("documents").select("doc_id", "source")
    toxic = d.join(t("labels").where("toxic = 1").select("doc_id"), "doc_id")
    return R.priority_union(toxic, d, "source", "doc_id", 6).select("doc_id", "source", "side")


@query(
    "statute_candidates",
    f"""WITH terms AS (SELECT item_id, {TERMS.format(match_sql('text'))} AS r FROM benchmark), docs AS (SELECT doc_id, {TERMS.format(match_sql('text'))} AS c FROM documents),
      met AS (SELECT doc_id, item_id, 0.08::DOUBLE * len(list_intersect(r, c)) / len(r) AS bonus FROM terms, docs WHERE len(r) > 0 AND len(list_intersect(r, c)) > 0)
      SELECT doc_id, count(*) AS rules, round(max(bonus), 8) AS best FROM met GROUP BY doc_id ORDER BY rules DESC, round(max(bonus), 9) DESC, doc_id LIMIT 12""",
)
def statute_candidates(t):
    """Rules against rows through shared terms, best by rules met."""
    rules = t("benchmark").select("item_id", T.retrieval_terms("text").alias("r")).select("item_id", F.size("r").alias("n"), F.explode("r").alias("term"))
    rows = t("documents").select("doc_id", F.explode_outer(T.retrieval_terms("text")).alias("term"))
    met = rules.join(rows, "term").groupBy("doc_id", "item_id").agg((0.08 * F.count(F.lit(1)) / F.first("n")).alias("bonus"))
    best = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"), F.max("bonus").alias("best"))
    return best.orderBy(F.desc("rules"), F.round("best", 9).desc(), "doc_id").limit(12).withColumn("best", F.round("best", 8))


@query("phrase_bonus", f"SELECT doc_id, 0.008::DOUBLE AS bonus, count(*) AS phrases FROM (SELECT doc_id, {match_sql('text')} AS t FROM documents) d JOIN (SELECT item_id, {match_sql('text')} AS p FROM benchmark) b ON contains(d.t, b.p) AND b.p <> '' GROUP BY doc_id")
def phrase_bonus(t):
    """Documents that hold a whole phrase; a rare token of each phrase leads to the few texts to search."""
    docs = t("documents").select("doc_id", T.match_text("text").alias("t"))
    phrases = t("benchmark").select("item_id", T.match_text("text").alias("p")).where("p <> ''")
    # whole tokens of a phrase except its first and last must occur as tokens: the longest of them is the key
    n = F.size(F.split("p", " "))
    inner = F.slice(F.split("p", " "), 2, n - 2)
    keyed = phrases.where(n > 2).withColumn("k", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    tokens = docs.select("doc_id", F.explode_outer(F.array_distinct(F.split("t", " "))).alias("k"))
    met = tokens.join(keyed.select("item_id", "k"), "k").select("doc_id", "item_id")
    held = met.join(docs, "doc_id").join(phrases, "item_id").where(F.contains("t", "p")).select("doc_id")
    # phrases of one or two words have no such token: every text is searched for them
    held = held.union(docs.join(F.broadcast(phrases.where(n <= 2)), F.contains("t", "p")).select("doc_id"))
    return held.groupBy("doc_id").agg(F.lit(0.008).alias("bonus"), F.count(F.lit(1)).alias("phrases"))


@query("law_status", "SELECT n_nationkey, coalesce(s.successor, 'current') AS status FROM nation LEFT JOIN (VALUES ('FRANCE', 'GERMANY'), ('CHINA', 'JAPAN'), ('IRAN', 'IRAQ')) s(name, successor) ON n_name = s.name")
def law_status(t):
    """J15"""
    table = F.create_map(*map(F.lit, ("FRANCE", "GERMANY", "CHINA", "JAPAN", "IRAN", "IRAQ")))
    return t("nation").select("n_nationkey", F.coalesce(F.try_element_at(table, F.col("n_name")), F.lit("current")).alias("status"))


@query("encoded_chunks", None)
def encoded_chunks(t):
    """Unit vectors of every document from the offline encoder, with their norms."""
    return R.hashing_encoder(t("documents"), "doc_id", "text").select("doc_id", F.size("vec").alias("dimensions"), F.round(R.norm("vec"), 6).alias("norm"))

