"""Queries of corpus build, profile, duplicates, clusters and the clean corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus as C
from quern.operators import sketch_join as SJ
from quern.plans.registry import query
from quern.plans.text_queries import clean_sql, dup_sql, tokens_sql, words_sql
from quern.sources.scratch import Scratch

CLEAN = f"SELECT doc_id, source, lang, {clean_sql('text')} AS text FROM documents"
BUILT = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS rn FROM ({CLEAN}) WHERE length(text) >= 100) WHERE rn = 1"
STATS = f"SELECT doc_id, source, lang, length(text) AS characters, len({words_sql('text')}) AS words, {tokens_sql('text')} AS tokens FROM documents"


def stats(t):
    return t("documents").select(
        "doc_id", "source", "lang", F.length("text").cast("long").alias("characters"), F.size(T.words("text")).cast("long").alias("words"), T.n_tokens("text").cast("long").alias("tokens")
    )


@query(
    "corpus_build",
    f"SELECT source, lang, count(*) AS documents, sum(length(text))::BIGINT AS characters, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({BUILT}) GROUP BY source, lang",
)
def corpus_build(t):
    """The corpus by source and language."""
    built = C.built_sizes(t("documents"))
    return built.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("characters").alias("characters"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("corpus_documents", f"SELECT doc_id, source, lang, md5(text) AS text_md5 FROM ({BUILT})")
def corpus_documents(t):
    """W10, X05"""
    return C.build_corpus(t("documents")).select("doc_id", "source", "lang", F.md5("text").alias("text_md5"))


@query(
    "build_counters",
    f"""SELECT source, count(*) AS read, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (length(text) >= 100 AND rn > 1) AS duplicates, count(*) FILTER (length(text) >= 100 AND rn = 1) AS written
      FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text), length(text) >= 100 ORDER BY source, doc_id) AS rn FROM ({CLEAN})) GROUP BY source""",
)
def build_counters(t):
    """Read, skipped and written per source."""
    clean = t("documents").select("doc_id", "source", T.clean_corpus_text("text").alias("text"))
    ranked = C.first_wins(clean.select("doc_id", "source", F.length("text").alias("n"), F.col("text").alias("c")), F.col("c"), "source", "doc_id")
    short = F.col("n") < C.MIN_CHARS
    return ranked.groupBy("source").agg(
        F.count(F.lit(1)).alias("read"), F.count_if(short).alias("short"), F.count_if(~short & (F.col("rank") > 1)).alias("duplicates"), F.count_if(~short & (F.col("rank") == 1)).alias("written")
    )


@query("page_range", "SELECT page_id FROM pages WHERE page_id BETWEEN 33 AND 283")
def page_range(t):
    """F02"""
    return t("pages").where(F.col("page_id").between(33, 283)).select("page_id")


@query(
    "status_filter",
    "SELECT d.doc_id, l.quality IS NULL OR l.quality = 1 AS lenient, coalesce(l.quality = 1, false) AS strict FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def status_filter(t):
    """F03"""
    q = F.col("quality")
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", (q.isNull() | (q == 1)).alias("lenient"), F.coalesce(q == 1, F.lit(False)).alias("strict"))


@query("min_words", f"SELECT doc_id FROM ({STATS}) WHERE words >= 20")
def min_words(t):
    """F04"""
    return stats(t).where("words >= 20").select("doc_id")


@query("valid_scenarios", "SELECT conv_id, turn FROM conversations WHERE role IS NOT NULL AND trim(role) <> '' AND length(trim(text)) >= 50")
def valid_scenarios(t):
    """F05"""
    return t("conversations").where(T.empty_to_null("role").isNotNull() & (F.length(F.trim("text")) >= 50)).select("conv_id", "turn")


@query(
    "exact_dups",
    f"SELECT md5(t) AS text_md5, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, {dup_sql('text')} AS t FROM documents) GROUP BY t HAVING count(*) > 1",
)
def exact_dups(t):
    """N05, X05, A09"""
    keyed = t("documents").select("doc_id", F.md5(T.for_duplicates("text")).alias("text_md5"))
    return keyed.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("copies > 1")


@query(
    "source_profile",
    f"""SELECT source, count(*) AS documents, sum(characters)::BIGINT AS characters, sum(words)::BIGINT AS words, sum(tokens)::BIGINT AS tokens, round(avg(tokens), 6) AS average_tokens,
      round(quantile_cont(tokens, 0.5), 6) AS median_tokens, round(quantile_cont(tokens, 0.95), 6) AS p95_tokens, max(tokens) AS max_tokens,
      round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 3) AS documents_percent, round(100.0::DOUBLE * sum(tokens) / sum(sum(tokens)) OVER (), 3) AS token_percent FROM ({STATS}) GROUP BY source""",
)
def source_profile(t):
    """A02, A05, W08"""
    return C.size_profile(stats(t), "source", "characters", "words", "tokens")


@query(
    "corpus_totals",
    f"SELECT count(*) AS documents, round(avg(words), 6) AS mean_words, min(words) AS min_words, max(words) AS max_words, round(median(words), 6) AS median_words, round(sum(tokens) / sum(words), 6) AS tokens_per_word FROM ({STATS})",
)
def corpus_totals(t):
    """A03, S07"""
    return stats(t).agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("words"), 6).alias("mean_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"),
        F.round(F.median("words"), 6).alias("median_words"), F.round(F.sum("tokens") / F.sum("words"), 6).alias("tokens_per_word"),
    )


POINTS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.995)


@query(
    "length_percentiles",
    " UNION ALL ".join(f"SELECT {p}::DOUBLE AS point, round(quantile_cont(tokens, {p}), 6) AS value FROM ({STATS})" for p in POINTS),
)
def length_percentiles(t):
    """A04"""
    return C.percentiles(stats(t), "tokens", POINTS)


LEVELS = (100.0, 500.0, 1000.0, 5000.0)


@query("size_buckets", " UNION ALL ".join(f"SELECT {v}::DOUBLE AS level, count(*) FILTER (tokens >= {v}) AS n FROM ({STATS})" for v in LEVELS))
def size_buckets(t):
    """A06, F07"""
    return C.thresholds(stats(t), "tokens", LEVELS)


RATIOS = (1.0, 1.1, 1.2, 1.5, 2.0, 3.0)


@query(
    "ratio_buckets",
    " UNION ALL ".join(f"SELECT {v}::DOUBLE AS level, count(*) FILTER (words > 0 AND tokens / words >= {v}) AS n FROM ({STATS})" for v in RATIOS),
)
def ratio_buckets(t):
    """A06, F07"""
    return C.thresholds(stats(t).where("words > 0").withColumn("ratio", F.col("tokens") / F.col("words")), "ratio", RATIOS)


@query("top_docs", f"SELECT doc_id, source, tokens FROM ({STATS}) ORDER BY tokens DESC, doc_id LIMIT 10")
def top_docs(t):
    """T02, T03"""
    return stats(t).select("doc_id", "source", "tokens").orderBy(F.desc("tokens"), "doc_id").limit(10)


EXCLUDED = f"""SELECT doc_id, CASE WHEN lang <> 'en' THEN 'vernacular' ELSE 'token_ratio' END AS primary_reason,
  concat_ws('; ', CASE WHEN lang <> 'en' THEN 'vernacular' END, CASE WHEN words > 0 AND tokens / words >= 1.2 THEN 'token_ratio' END) AS all_reasons
  FROM ({STATS}) WHERE lang <> 'en' OR (words > 0 AND tokens / words >= 1.2)"""


def excluded(t, own=None):
    ratio = F.when(F.col("words") > 0, F.col("tokens") / F.col("words")).otherwise(0.0)
    return C.quality_exclusions(stats(t) if own is None else own, [("vernacular", F.col("lang") != "en"), ("token_ratio", ratio >= 1.2)], "doc_id")


@query("quality_exclusions", EXCLUDED)
def quality_exclusions(t):
    """F06"""
    return excluded(t)


@query(
    "merged_exclusions",
    f"""WITH a AS ({EXCLUDED}), b AS (SELECT doc_id, 'toxic' AS primary_reason, 'toxic' AS all_reasons FROM labels WHERE toxic = 1)
      SELECT doc_id, coalesce(a.primary_reason, b.primary_reason) AS primary_reason, concat_ws('; ', a.all_reasons, b.all_reasons) AS all_reasons FROM a FULL JOIN b USING (doc_id)""",
)
def merged_exclusions(t):
    """U08"""
    toxic = C.quality_exclusions(t("labels"), [("toxic", F.col("toxic") == 1)], "doc_id")
    return C.merge_exclusions(excluded(t), toxic, "doc_id")


def _prints(t):
    titled = t("documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))
    return C.fingerprints(titled)


WORDED = f"""SELECT doc_id, source || ' ' || lang AS title, t, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+') AS w FROM (SELECT *, {dup_sql('text')} AS t FROM documents)"""
HASH60 = "('0x' || left(md5({}), 15))::BIGINT"
SIGNED = f"""SELECT doc_id, title, len(w) AS words, length(t) AS characters, sha256(t) AS exact_hash,
  CASE WHEN len(w) = 0 THEN []::BIGINT[] ELSE list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: {HASH60.format("array_to_string(w[i:i + 4], ' ')")})))[1:128] END AS signature FROM ({WORDED})"""
VOTED = f"""SELECT doc_id, CASE WHEN count(h) = 0 THEN 0 ELSE {' + '.join(f'(CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << b} ELSE 0 END)::BIGINT' for b in range(60))} END AS simhash
  FROM (SELECT doc_id, {HASH60.format('u')} AS h FROM (SELECT doc_id, unnest(w) AS u FROM ({WORDED})) ) GROUP BY doc_id"""
PRINTS = f"SELECT s.*, coalesce(v.simhash, 0) AS simhash, signature[1] AS block FROM ({SIGNED}) s LEFT JOIN ({VOTED}) v USING (doc_id)"
LEN_SIM = "CASE WHEN least(a.{0}, b.{0}) > 0 THEN least(a.{0}, b.{0}) / greatest(a.{0}, b.{0}) ELSE 0 END"
PAIRS = f"""SELECT case_key, id_a, id_b, exact_normalized_match, shingle, sim, length, title, CASE WHEN exact_normalized_match THEN 'exact_duplicate' WHEN shingle >= .9 AND sim >= .9 AND length >= .9 THEN 'probable_near_duplicate'
    WHEN (shingle >= .7 AND length >= .8) OR (shingle >= .8 AND sim >= .8) THEN 'review' ELSE 'likely_distinct' END AS classification,
    CASE WHEN exact_normalized_match THEN 1.0::DOUBLE ELSE .5::DOUBLE * shingle + .25::DOUBLE * sim + .2::DOUBLE * length + .05::DOUBLE * title END AS confidence
  FROM (SELECT a.block AS case_key, a.doc_id AS id_a, b.doc_id AS id_b, a.exact_hash = b.exact_hash AS exact_normalized_match,
      len(list_intersect(a.signature, b.signature)) / least(len(a.signature), len(b.signature)) AS shingle, 1 - bit_count(xor(a.simhash, b.simhash)) / 60 AS sim,
      (({LEN_SIM.format('words')}) + ({LEN_SIM.format('characters')})) / 2 AS length,
      len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) / len(list_distinct(list_concat(string_split(a.title, ' '), string_split(b.title, ' ')))) AS title
    FROM prints a JOIN prints b ON a.block = b.block AND a.doc_id < b.doc_id)"""
WITH_PAIRS = f"WITH RECURSIVE prints AS MATERIALIZED ({PRINTS}), pairs AS MATERIALIZED ({PAIRS})"
CLUSTERS = """edges AS (SELECT id_a AS a, id_b AS b FROM pairs WHERE classification IN ('exact_duplicate', 'probable_near_duplicate')),
  both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON r.m = e.a),
  groups AS (SELECT n AS doc_id, min(m) AS component FROM reach GROUP BY n), sizes AS (SELECT component, count(*) AS cluster_size FROM groups GROUP BY component),
  named AS (SELECT *, 'dup_cluster_' || lpad((row_number() OVER (ORDER BY cluster_size DESC, component))::VARCHAR, 5, '0') AS cluster_id FROM sizes),
  clusters AS (SELECT doc_id, component, cluster_id, cluster_size FROM groups JOIN named USING (component))"""


@query("signatures", f"SELECT doc_id, len(signature) AS n, list_sum(list_transform(signature, lambda h: h % 1000003))::BIGINT AS checksum, signature[1] AS lowest FROM ({SIGNED})")
def signatures(t):
    """X04, X06, X07"""
    prints = _prints(t)
    mod = F.aggregate(F.transform("signature", lambda h: h % 1000003), F.lit(0).cast("long"), lambda a, x: a + x)
    return prints.select("doc_id", F.size("signature").cast("long").alias("n"), F.when(F.size("signature") > 0, mod).alias("checksum"), F.col("block").alias("lowest"))


@query("simhash", f"SELECT doc_id, simhash FROM ({PRINTS})")
def simhash(t):
    """X08"""
    return _prints(t).select("doc_id", "simhash")


@query(
    "near_dup_pairs",
    f"{WITH_PAIRS} SELECT id_a, id_b, classification, exact_normalized_match, round(shingle, 4) AS shingle_similarity, round(sim, 4) AS simhash_similarity, round(length, 4) AS length_similarity, round(title, 4) AS title_similarity, round(confidence, 4) AS confidence FROM pairs",
)
def near_dup_pairs(t):
    """J03, J05, X09, X10, X11, X12, X13"""
    pairs = C.near_duplicate_pairs(_prints(t))
    rounded = {"shingle": "shingle_similarity", "sim": "simhash_similarity", "length": "length_similarity", "title": "title_similarity", "confidence": "confidence"}
    return pairs.select("id_a", "id_b", "classification", "exact_normalized_match", *(F.round(a, 4).alias(b) for a, b in rounded.items()))


@query(
    "near_dup_groups",
    f"""{WITH_PAIRS}, ids AS (SELECT case_key, id_a AS i FROM pairs UNION SELECT case_key, id_b FROM pairs), joined AS (SELECT case_key, count(*) AS document_count, string_agg(i::VARCHAR, ' | ' ORDER BY i) AS document_ids FROM ids GROUP BY case_key)
      SELECT case_key, count(*) AS pair_count, count(*) FILTER (classification = 'exact_duplicate') AS exact_duplicate_pairs, count(*) FILTER (classification = 'probable_near_duplicate') AS probable_near_duplicate_pairs,
        count(*) FILTER (classification = 'review') AS review_pairs, count(*) FILTER (classification = 'likely_distinct') AS likely_distinct_pairs, round(max(confidence), 4) AS highest_confidence, document_count, document_ids
      FROM pairs JOIN joined USING (case_key) GROUP BY ALL""",
)
def near_dup_groups(t):
    """A10, S06"""
    return C.pair_groups(C.near_duplicate_pairs(_prints(t)))


ORDER = "CASE classification WHEN 'exact_duplicate' THEN 0 WHEN 'probable_near_duplicate' THEN 1 WHEN 'review' THEN 2 ELSE 3 END"


@query("suspicious_pairs", f"{WITH_PAIRS} SELECT id_a, id_b, classification FROM pairs WHERE classification <> 'likely_distinct' ORDER BY {ORDER}, round(confidence, 4) DESC, id_a, id_b LIMIT 20")
def suspicious_pairs(t):
    """T04, T05"""
    pairs = C.near_duplicate_pairs(_prints(t)).where("classification <> 'likely_distinct'")
    return pairs.orderBy(F.expr(ORDER), F.round("confidence", 4).desc(), "id_a", "id_b").limit(20).select("id_a", "id_b", "classification")


@query("dup_clusters", f"{WITH_PAIRS}, {CLUSTERS} SELECT doc_id, cluster_id, cluster_size FROM clusters")
def dup_clusters(t):
    """A18, F09, W07"""
    return C.duplicate_clusters(C.cluster_edges(_prints(t))).select("doc_id", "cluster_id", "cluster_size")


SKETCHED = f"""WITH RECURSIVE prints AS MATERIALIZED ({PRINTS}), texts AS (SELECT min(doc_id) AS first_id, exact_hash FROM prints GROUP BY exact_hash), heads AS MATERIALIZED (SELECT p.* FROM prints p JOIN texts ON doc_id = first_id),
  hashes AS (SELECT doc_id, unnest(signature) AS h FROM heads), met AS (SELECT DISTINCT a.doc_id AS id_a, b.doc_id AS id_b FROM hashes a JOIN hashes b ON a.h = b.h AND a.doc_id < b.doc_id),
  scores AS (SELECT id_a, id_b, len(list_intersect(a.signature, b.signature)) / least(len(a.signature), len(b.signature)) AS shingle, 1 - bit_count(xor(a.simhash, b.simhash)) / 60 AS sim,
      (({LEN_SIM.format('words')}) + ({LEN_SIM.format('characters')})) / 2 AS length FROM met JOIN heads a ON a.doc_id = id_a JOIN heads b ON b.doc_id = id_b),
  pairs AS MATERIALIZED (SELECT first_id AS id_a, doc_id AS id_b, 'exact_duplicate' AS classification, 1.0::DOUBLE AS shingle, 1.0::DOUBLE AS sim, 1.0::DOUBLE AS length FROM prints JOIN texts USING (exact_hash) WHERE doc_id <> first_id
    UNION ALL SELECT id_a, id_b, CASE WHEN shingle >= .9 AND sim >= .9 AND length >= .9 THEN 'probable_near_duplicate' ELSE 'review' END, shingle, sim, length FROM scores
      WHERE (shingle >= .9 AND sim >= .9 AND length >= .9) OR (shingle >= .7 AND length >= .8) OR (shingle >= .8 AND sim >= .8))"""


@query("sketch_pairs", f"{SKETCHED} SELECT id_a, id_b, classification, round(shingle, 4) AS shingle_similarity, round(sim, 4) AS simhash_similarity, round(length, 4) AS length_similarity FROM pairs")
def sketch_pairs(t):
    """Every pair of different texts that any shared hash makes, copies collapsed first."""
    pairs = SJ.sketch_pairs(t("documents"))
    return pairs.select("id_a", "id_b", "classification", *(F.round(a, 4).alias(b) for a, b in (("shingle", "shingle_similarity"), ("sim", "simhash_similarity"), ("length", "length_similarity"))))


@query("sketch_clusters", f"{SKETCHED}, {CLUSTERS} SELECT doc_id, component, cluster_size FROM clusters")
def sketch_clusters(t):
    """Clusters over all pairs"""
    return SJ.sketch_clusters(t("documents"))


SCORED = f"""scored AS (SELECT c.*, s.tokens, s.source, CASE WHEN l.quality = 1 THEN 2 WHEN l.quality IS NULL THEN 1 ELSE 0 END AS status_score,
  (CASE WHEN s.lang = 'en' THEN 1 ELSE 0 END) + 1 AS filled FROM clusters c JOIN ({STATS}) s USING (doc_id) LEFT JOIN labels l USING (doc_id)),
  chosen AS (SELECT *, first_value(doc_id) OVER (PARTITION BY cluster_id ORDER BY status_score DESC, filled DESC, tokens DESC, doc_id) AS canonical FROM scored)"""


def _measured(t):
    """stats(), written once: the clean corpus reads it several times."""
    own = stats(t)
    return Scratch(own.sparkSession, "stats").cut(own, "stats")


def _chosen(t, own=None):
    clusters = C.duplicate_clusters(C.cluster_edges(_prints(t)))
    joined = clusters.join(stats(t) if own is None else own, "doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, 2).when(F.col("quality").isNull(), 1).otherwise(0)
    fields = joined.withColumn("english", F.when(F.col("lang") == "en", F.col("lang")))
    scored = fields.withColumns({"status_score": status, "filled": C.completeness("source", "english")})
    return C.canonical_members(scored, "doc_id", "cluster_id", F.desc("status_score"), F.desc("filled"), F.desc("tokens"))


@query("canonical_docs", f"{WITH_PAIRS}, {CLUSTERS}, {SCORED} SELECT doc_id, cluster_id, canonical AS canonical_id, doc_id = canonical AS is_canonical FROM chosen")
def canonical_docs(t):
    """W03, X38, J13"""
    return _chosen(t).select("doc_id", "cluster_id", F.col("canonical").alias("canonical_id"), (F.col("doc_id") == F.col("canonical")).alias("is_canonical"))


@query(
    "clean_corpus",
    f"{WITH_PAIRS}, {CLUSTERS}, {SCORED} SELECT doc_id, source, tokens FROM ({STATS}) WHERE doc_id NOT IN (SELECT doc_id FROM chosen WHERE doc_id <> canonical) AND doc_id NOT IN (SELECT doc_id FROM ({EXCLUDED}))",
)
def clean_corpus(t):
    """J04"""
    own = _measured(t)
    gone = _chosen(t, own).where("doc_id <> canonical").select("doc_id").union(excluded(t, own).select("doc_id"))
    return own.join(gone, "doc_id", "left_anti").select("doc_id", "source", "tokens")


@query(
    "clean_summary",
    f"""{WITH_PAIRS}, {CLUSTERS}, {SCORED}, kept AS (SELECT * FROM ({STATS}) WHERE doc_id NOT IN (SELECT doc_id FROM chosen WHERE doc_id <> canonical)),
      a AS (SELECT source, count(*) AS docs_before, sum(tokens)::BIGINT AS tokens_before FROM ({STATS}) GROUP BY source), b AS (SELECT source, count(*) AS docs_after, sum(tokens)::BIGINT AS tokens_after FROM kept GROUP BY source)
      SELECT source, docs_before, tokens_before, coalesce(docs_after, 0) AS docs_after, coalesce(tokens_after, 0) AS tokens_after, docs_before - coalesce(docs_after, 0) AS docs_removed,
        tokens_before - coalesce(tokens_after, 0) AS tokens_removed, round(100.0::DOUBLE * coalesce(tokens_after, 0) / tokens_before, 3) AS retained_percent FROM a FULL JOIN b USING (source)""",
)
def clean_summary(t):
    """A20"""
    own = _measured(t)
    gone = _chosen(t, own).where("doc_id <> canonical").select("doc_id")
    return C.before_after(own, own.join(gone, "doc_id", "left_anti"), "source", "tokens")


@query("semi_candidates", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_candidates(t):
    """J03"""
    return t("documents").select("doc_id", "source").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("fk_check", "SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def fk_check(t):
    """Every label has a document, or the query fails."""
    return C.enforced_join(C.assert_unique(t("labels"), "doc_id").select("doc_id", "quality"), t("documents").select("doc_id", "source"), "doc_id")


@query("missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(t):
    """U06"""
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").distinct()


@query(
    "key_sets",
    "SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (d.doc_id = l.doc_id) AS in_both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
def key_sets(t):
    """J11"""
    d, l = t("documents").select(F.col("doc_id").alias("a")), t("labels").select(F.col("doc_id").alias("b"))
    return d.join(l, F.col("a") == F.col("b"), "full_outer").agg(
        F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a") == F.col("b")).alias("in_both")
    )


@query(
    "token_diff",
    f"""WITH a AS (SELECT w, count(*) AS na FROM (SELECT unnest({words_sql('text')}) AS w FROM documents) GROUP BY w), b AS (SELECT w, count(*) AS nb FROM (SELECT unnest({words_sql('text')}) AS w FROM benchmark) GROUP BY w)
      SELECT w AS token, greatest(coalesce(na, 0) - coalesce(nb, 0), 0) AS missing, greatest(coalesce(nb, 0) - coalesce(na, 0), 0) AS extra FROM a FULL JOIN b USING (w)""",
)
def token_diff(t):
    """The words of the documents against those of the benchmark."""
    sides = [t(name).select(F.explode_outer(T.words("text")).alias("token")).where("token is not null") for name in ("documents", "benchmark")]
    return C.multiset_difference(*sides, "token")


@query("column_counts", "SELECT count(*) AS n, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (trim(text) = '') AS empty FROM documents")
def column_counts(t):
    """A23, A22"""
    n = F.count(F.lit(1))
    return t("documents").agg(n.alias("n"), F.countDistinct("text").alias("distinct_texts"), (n - F.countDistinct("text")).alias("repeated"), F.count_if(F.trim("text") == "").alias("empty"))


@query(
    "flag_counts",
    f"SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN characters < 100 THEN 'short' END, CASE WHEN words > 2000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'other_language' END], lambda x: x IS NOT NULL)) AS flag FROM ({STATS})) GROUP BY flag",
)
def flag_counts(t):
    """A22"""
    flags = F.array_compact(F.array(F.when(F.col("characters") < 100, "short"), F.when(F.col("words") > 2000, "long"), F.when(F.col("lang") != "en", "other_language")))
    return stats(t).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("date_histogram", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1")
def date_histogram(t):
    """A24"""
    d = F.col("o_orderdate")
    return t("orders").groupBy(F.year(d).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min(d).cast("date").alias("first_day"), F.max(d).cast("date").alias("last_day"))


@query("hash_sample", None)
def hash_sample(t):
    """A detail level per row and a seeded sample of 50, ordered by id."""
    level = F.element_at(F.array(*map(F.lit, ("VAGUE", "NORMAL", "DETAILED"))), (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) + 1).cast("int"))
    return t("documents").select("doc_id", level.alias("detail_level")).orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(50).orderBy("doc_id")


@query("numbered_rows", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, count(*) OVER (PARTITION BY source) AS of_rows FROM documents")
def numbered_rows(t):
    """W07, W08"""
    by = Window.partitionBy("source")
    return t("documents").select("doc_id", F.row_number().over(by.orderBy("doc_id")).cast("long").alias("number"), F.count(F.lit(1)).over(by).alias("of_rows"))
