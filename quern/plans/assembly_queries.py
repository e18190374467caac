"""Queries of merged and aligned records, heading spans, statute rules, structured answers, and of the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import assemble as A
from quern.plans.registry import query
from quern.sources import readers as R
from quern.sources.scratch import Scratch


@query(
    "merged_scenarios",
    """WITH r AS (SELECT doc_id AS o, lang || ' ' || source AS scenario, [CASE WHEN doc_id % 2 = 0 THEN 'Act ' ELSE 'ACT ' END || (doc_id % 5), 'Code ' || (doc_id % 3)] AS l FROM documents WHERE lang || ' ' || source IS NOT NULL AND doc_id % 11 <> 4),
      e AS (SELECT o, scenario, unnest(l) AS label, unnest([0, 1]) AS i FROM r),
      f AS (SELECT lower(scenario) AS key, min((o, i, label)) AS said FROM e GROUP BY lower(scenario), lower(label)),
      s AS (SELECT key, string_agg(said[3], '; ' ORDER BY said) AS statutes FROM f GROUP BY key),
      n AS (SELECT lower(scenario) AS key, count(*) AS n_rows, min((o, scenario)) AS told FROM r GROUP BY lower(scenario))
    SELECT 'scenario_' || lpad((row_number() OVER (ORDER BY told) - 1)::VARCHAR, 6, '0') AS scenario_id, told[2] AS scenario, statutes, n_rows FROM n JOIN s USING (key)""",
)
def merged_scenarios(t):
    """Documents as scenarios named by language and source; some have no statutes."""
    act = F.concat(F.when(F.col("doc_id") % 2 == 0, "Act ").otherwise("ACT "), F.col("doc_id") % 5)
    listed = F.when(F.col("doc_id") % 11 == 4, F.array(F.lit(" "))).otherwise(F.array(act, F.concat(F.lit("Code "), F.col("doc_id") % 3)))
    rows = t("documents").select("doc_id", F.concat("lang", F.lit(" "), "source").alias("scenario"), listed.alias("statutes"))
    return A.merged_scenarios(rows, "doc_id", "scenario", "statutes").withColumn("statutes", F.array_join("statutes", "; "))


@query(
    "aligned_vectors",
    "SELECT place, record, vec_id FROM (SELECT vec_id * 3 + 7 AS record, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) USING (place)",
)
def aligned_vectors(t):
    """Records with ids of their own, and the vectors at the same places."""
    vectors = t("embeddings").select("vec_id", "embedding")
    records = t("embeddings").select((F.col("vec_id") * 3 + 7).alias("record"))
    return A.aligned(records, "record", vectors, "vec_id", "embedding").select("place", "record", "vec_id")


@query(
    "heading_spans",
    """WITH p AS (SELECT conv_id, turn, length((turn + 1) || '.  [Part of' || chr(10) || 'turn ' || turn || chr(10) || coalesce(text, '') || chr(10)) AS n FROM conversations),
      q AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS start, sum(n) OVER (PARTITION BY conv_id) AS total FROM p),
      c AS (SELECT conv_id, max(total) AS total, count(*) FILTER (turn = 0) AS n0, count(*) FILTER (turn = 1) AS n1, count(*) FILTER (turn = 2) AS n2, max(start) FILTER (turn = 0) AS s0, max(start) FILTER (turn = 1) AS s1, max(start) FILTER (turn = 2) AS s2 FROM q GROUP BY conv_id),
      d AS (SELECT *, CASE WHEN n0 <> 1 THEN '1: found ' || n0 WHEN n1 <> 1 THEN '2: found ' || n1 WHEN n2 <> 1 THEN '3: found ' || n2 END AS problem FROM c)
    SELECT conv_id, number, start::INTEGER AS start, stop::INTEGER AS stop, problem FROM (SELECT conv_id, problem, unnest(['1', '2', '3']) AS number, unnest([s0, s1, s2]) AS start, unnest([s1, s2, total]) AS stop FROM d WHERE problem IS NULL)
    UNION ALL SELECT conv_id, NULL, NULL, NULL, problem FROM d WHERE problem IS NOT NULL""",
)
def heading_spans(t):
    """Conversations as texts of numbered parts, of which the first three are expected."""
    part = F.concat(F.col("turn") + 1, F.lit(".  [Part of\nturn "), "turn", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    texts = t("conversations").groupBy("conv_id").agg(F.array_join(parts, "").alias("text"))
    return A.heading_spans(texts, "conv_id", "text", [(str(i + 1), f"Part of turn {i}") for i in range(3)])


_SOURCES = """SELECT d.source, d.doc_id, d.text, l.quality * 3 AS legal_score, coalesce(l.toxic = 1, false) AS verified,
  CASE WHEN d.lang = 'en' THEN 'supreme_court' ELSE 'act' END AS source_type FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _sources(t):
    rows = t("documents").select("source", "doc_id", "text", "lang").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    said = lambda word, k: F.struct(F.concat(F.lit(f"{word} "), F.col("doc_id") % k, F.lit(".")).alias("proposition"), F.lit(" all ").alias("scope_limit"))
    return rows.select(
        "source", "doc_id", "text", (F.col("quality") * 3).alias("legal_score"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("verified"), F.when(F.col("lang") == "en", "supreme_court").otherwise("act").alias("source_type"),
        F.col("lang").alias("title"), F.concat(F.lit("S"), "doc_id").alias("source_id"), F.array(said("Rule", 9), said("RULE", 4)).alias("propositions"),
    )


@query(
    "completion_rules",
    f"""WITH s AS ({_SOURCES}), u AS (SELECT * FROM s WHERE source_type = 'supreme_court' AND (verified OR legal_score >= 1)),
      e AS (SELECT source, doc_id, verified, 0 AS i, 'Rule ' || (doc_id % 9) || '.' AS p FROM u UNION ALL SELECT source, doc_id, verified, 1, 'RULE ' || (doc_id % 4) || '.' FROM u),
      o AS (SELECT source, verified, min((doc_id, i, p)) AS f FROM e GROUP BY source, verified, lower(p)),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, verified ORDER BY f) AS n, bool_or(verified) OVER (PARTITION BY source) AS any_verified FROM o)
    SELECT source, 'R' || n AS rule_id, f[3] AS proposition, 'all' AS scope_limit, 'en' AS title, 'S' || f[1] AS source_id, verified FROM r WHERE n <= 6 AND verified = any_verified""",
)
def completion_rules(t):
    """A source of documents is a session."""
    return A.completion_rules(_sources(t).where("source is not null"), "source", "doc_id")


@query(
    "preliminary_sources",
    f"SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM ({_SOURCES}) WHERE legal_score >= 1 AND regexp_matches(text, '\\S')) WHERE place <= 4",
)
def preliminary_sources(t):
    """L11"""
    return A.preliminary_sources(_sources(t), "source", "doc_id", "text").select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query(
    "required_answers",
    """SELECT conv_id, turn, turn % 5 IN (1, 2, 3, 4) AS repaired, CASE turn % 5 WHEN 2 THEN 'missing: queries' WHEN 3 THEN 'no JSON' WHEN 4 THEN 'type: queries' END AS problem FROM conversations WHERE text IS NOT NULL""",
)
def required_answers(t):
    """Whole answers, answers cut off at the end (which the repair closes), without a key, prose, and with a key of another kind."""
    k, status = F.col("turn") % 5, F.struct(F.lit("READY").alias("status"))
    whole = F.to_json(F.struct(F.lit("READY").alias("status"), F.array("text").alias("queries")))
    other = F.to_json(F.struct(F.lit("READY").alias("status"), F.col("text").alias("queries")))
    answer = F.when(k == 0, whole).when(k == 1, F.expr("substring({0}, 1, length({0}) - 1)".format("whole"))).when(k == 2, F.to_json(status)).when(k == 3, F.concat(F.lit("I say "), "text")).otherwise(F.col("other"))
    rows = t("conversations").where("text is not null").select("conv_id", "turn", "text", whole.alias("whole"), other.alias("other")).select("conv_id", "turn", answer.alias("answer"))
    closed = lambda df: df.withColumn("answer", F.when(F.startswith("answer", F.lit("{")) & ~F.endswith("answer", F.lit("}")), F.concat("answer", F.lit("}"))).otherwise(F.col("answer")))
    return A.required_answers(rows, "answer", {"status": "STRING", "queries": "ARRAY"}, closed).select("conv_id", "turn", "repaired", "problem")


# ---- readers


def _folder(t) -> Scratch:
    return Scratch(t("documents").sparkSession, "files")


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def jsonl_round_trip(t):
    """Documents written as lines of JSON, and read by the strict scan."""
    docs, folder = t("documents").select("doc_id", "text", "lang"), _folder(t)
    path = folder.path("strict")
    R.write_jsonl(docs, path)
    return R.read_jsonl_strict(docs.sparkSession, path, docs.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("jsonl_lenient", "SELECT count(*) FILTER (doc_id % 10 <> 3) AS good_lines, count(*) FILTER (doc_id % 10 = 3) AS bad_lines, sum(doc_id) FILTER (doc_id % 10 <> 3)::BIGINT AS ids FROM documents")
def jsonl_lenient(t):
    """Every tenth line is cut off; bad lines are left out and counted."""
    docs, folder = t("documents"), _folder(t)
    line = F.to_json(F.struct("doc_id", "lang"))
    path = folder.path("lenient")
    docs.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = R.read_jsonl_lenient(docs.sparkSession, path, "doc_id long, lang string")
    return good.agg(F.count(F.lit(1)).alias("good_lines"), F.sum("doc_id").alias("ids")).crossJoin(F.broadcast(bad)).select("good_lines", "bad_lines", "ids")  # one row each


@query("jsonl_append", "SELECT lang, count(*) * 2 AS n FROM documents GROUP BY lang")
def jsonl_append(t):
    """A table, its reset by another write, and an append."""
    docs, folder = t("documents").select("doc_id", "lang"), _folder(t)
    path = folder.path("append")
    for append in (False, False, True):
        R.write_jsonl(docs, path, append=append)
    return R.read_jsonl_strict(docs.sparkSession, path, docs.schema).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("upload_list", "SELECT doc_id AS path FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def upload_list(t):
    """Files that the manifest has not, or has with another hash."""
    local = t("documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old = F.when(F.col("path") % 7 == 0, F.lit("0")).otherwise(F.col("sha256"))
    return R.to_upload(local, local.where("path % 5 <> 0").withColumn("sha256", old)).select("path")


@query("rows_by_id", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT vec_id * 3 FROM embeddings)")
def rows_by_id(t):
    """S12"""
    return R.rows_by_id(t("documents"), t("embeddings").select((F.col("vec_id") * 3).alias("doc_id")), "doc_id").select("doc_id", "n_chars")


@query("table_inspection", "SELECT 'bigint' AS doc_id_type, 2 AS n_columns, least(count(*), 5) AS n_rows FROM documents")
def table_inspection(t):
    """The first file of those that exist, its columns and first rows."""
    docs, folder = t("documents").select("doc_id", "lang"), _folder(t)
    path = folder.path("table") + ".jsonl"
    R.write_jsonl(docs, path)
    found = R.first_present(docs.sparkSession, [folder.path("none") + ".csv", path])
    _, rows = R.inspect(docs.sparkSession, found)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.agg(F.lit(kind).alias("doc_id_type"), F.lit(len(rows.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n_rows"))


@query("json_folder", "SELECT ok, count(*) AS n, count(DISTINCT ids) AS hashes FROM (SELECT sum(doc_id) % 3 <> 1 AS ok, sum(doc_id) AS ids FROM documents GROUP BY lang, source) GROUP BY ok")
def json_folder(t):
    """A folder with a file for each language and source, some of them no JSON; each file stands alone."""
    docs, folder = t("documents"), _folder(t)
    path = folder.path("folder")
    ids = docs.groupBy("lang", "source").agg(F.sum("doc_id").alias("ids"))
    body = F.when(F.col("ids") % 3 == 1, F.concat(F.lit("{cut "), "ids")).otherwise(F.to_json(F.struct("ids")))
    ids.select("lang", "source", body.alias("value")).repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    return R.read_json_documents(docs.sparkSession, path).groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha256").alias("hashes"))
