"""Queries of gates, audits, JSON repair, logs and incremental state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import repair as J
from quern.functions import text as T
from quern.operators import verify as V
from quern.plans.registry import query


@query(
    "conversation_render",
    "SELECT conv_id, string_agg(CASE WHEN i = 0 THEN 'Problem: ' || text ELSE i || '. ' || text END, chr(10) ORDER BY turn, text) AS conversation FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations) GROUP BY conv_id",
)
def conversation_render(t):
    """L01"""
    return V.conversation_text(t("conversations"), "conv_id", "turn", "text")


@query(
    "followup_dedupe",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) ORDER BY turn) AS n FROM conversations) WHERE n = 1",
)
def followup_dedupe(t):
    """The first of equal questions in a conversation."""
    keyed = t("conversations").select("conv_id", "turn", T.question_key("text").alias("k"))
    return keyed.groupBy("conv_id", "k").agg(F.min("turn").alias("turn")).select("conv_id", "turn")


@query("judge_gate", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' ELSE 'FAIL' END AS overall FROM labels")
def judge_gate(t):
    """A26"""
    said = t("labels").select("doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("useful"), F.when(F.col("toxic") == 0, "PASS").alias("harmless"))
    return said.select("doc_id", V.judged_overall("useful", "harmless").alias("overall"))


@query(
    "sample_routes",
    """SELECT route, count(*) AS n FROM (SELECT CASE WHEN length(trim(c.text)) < 35 OR length(trim(d.text)) < 80 THEN 'errors' WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' ELSE 'rejected' END AS route
      FROM labels l JOIN documents d USING (doc_id) JOIN conversations c ON c.conv_id = l.doc_id AND c.turn = 0) GROUP BY route""",
)
def sample_routes(t):
    """L19"""
    c = t("conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("question"))
    rows = t("labels").join(t("documents").select("doc_id", F.col("text").alias("answer")), "doc_id").join(c, "doc_id")
    judged = rows.withColumn("overall", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PASS").otherwise("FAIL"))
    return V.routed_samples(judged, "question", "answer", "overall").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


CLAIMS = """SELECT conv_id, turn, CASE WHEN kind IN ('SUPPORTED', 'PARTIAL', 'UNSUPPORTED') AND turn < 6 AND trim(text) <> '' THEN kind ELSE 'UNSUPPORTED' END AS verdict, turn, text FROM
  (SELECT *, CASE turn % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'SUPPORTED' ELSE 'MAYBE' END AS kind FROM conversations)"""


def _claims(t):
    kind = F.element_at(F.array(*map(F.lit, ("supported", "partial", "Supported ", "maybe"))), (F.col("turn") % 4 + 1).cast("int"))
    raw = t("conversations").select("conv_id", "turn", kind.alias("verdict"), F.array(F.concat(F.lit("S"), F.col("turn") + 1)).alias("supported_by"), F.col("text").alias("safe_claim"))
    return V.cleaned_claims(raw, F.array(*(F.lit(f"S{i}") for i in range(1, 7))))


@query("claim_audit", f"SELECT conv_id, turn, verdict, verdict <> 'UNSUPPORTED' AS kept FROM ({CLAIMS})")
def claim_audit(t):
    """L13"""
    return _claims(t).select("conv_id", "turn", "verdict", (F.size("supported_by") > 0).alias("kept"))


@query("verdict_counts", f"SELECT verdict, count(*) AS n FROM ({CLAIMS}) GROUP BY verdict")
def verdict_counts(t):
    """A27"""
    return _claims(t).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("allow_list", f"SELECT conv_id, string_agg('- ' || trim(text) || ' [S' || (turn + 1) || ']', chr(10) ORDER BY turn, text) AS answer FROM ({CLAIMS}) WHERE verdict IN ('SUPPORTED', 'PARTIAL') GROUP BY conv_id")
def allow_list(t):
    """L14, L16"""
    return V.fail_closed_answer(V.allowed_claims(_claims(t)), "conv_id", "turn")


@query(
    "audit_gate",
    f"SELECT conv_id, count(*) AS claims, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'UNSUPPORTED') AS unsupported, bool_and(verdict = 'SUPPORTED') AS passes FROM ({CLAIMS}) GROUP BY conv_id",
)
def audit_gate(t):
    """L15"""
    return V.audit_passes(_claims(t), "conv_id")


@query("citation_check", "SELECT conv_id, turn, CASE WHEN turn > 4 THEN 'S' || (turn + 2) ELSE '' END AS invalid FROM conversations")
def citation_check(t):
    """L16, V05, N28"""
    cited = F.concat("text", F.lit(" 【S1】 and [S"), F.col("turn") + 2, F.lit("]"))
    rows = t("conversations").select("conv_id", "turn", T.plain_citations(cited).alias("x"))
    return rows.select("conv_id", "turn", F.array_join(V.invalid_citations("x", F.array(*(F.lit(f"S{i}") for i in range(1, 7)))), ",").alias("invalid"))


@query(
    "verify_defaults",
    "SELECT doc_id, coalesce(quality, 0) AS score, CASE WHEN toxic = 1 THEN 'REJECT' WHEN toxic = 0 THEN 'KEEP' ELSE 'UNREVIEWED' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)",
)
def verify_defaults(t):
    """J16, L06"""
    results = t("labels").select("doc_id", F.col("quality").alias("score"), V.clamp(F.when(F.col("toxic") == 1, "reject").otherwise("Keep"), ("KEEP", "REJECT", "NEEDS_FACT"), "UNREVIEWED").alias("verdict"))
    return V.with_defaults(t("documents").select("doc_id"), results, "doc_id", {"score": 0, "verdict": "UNREVIEWED"})


@query("analogy_rerank", "SELECT doc_id, least(3, quality * 3) AS score FROM labels JOIN documents USING (doc_id) WHERE quality * 3 >= 2 ORDER BY least(3, quality * 3) DESC, n_chars DESC, doc_id LIMIT 5")
def analogy_rerank(t):
    """L04, L05, F08"""
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").withColumn("score", F.col("quality") * 3)
    return V.accepted_analogies(rows, "score", "n_chars", "doc_id").select("doc_id", "score")


@query(
    "passage_gate",
    """SELECT doc_id, score, n_propositions, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, n_propositions DESC, n_chars DESC, doc_id) AS rank FROM (
      SELECT doc_id, n_chars, CASE WHEN toxic = 1 THEN least(quality * 3, 1) WHEN quality * 3 >= 2 AND lang <> 'en' THEN 1 ELSE quality * 3 END AS score, CASE WHEN toxic = 1 THEN 0 WHEN lang = 'en' THEN 1 ELSE 0 END AS n_propositions FROM labels JOIN documents USING (doc_id))
      WHERE score >= 2 AND n_propositions > 0) WHERE rank <= 6""",
)
def passage_gate(t):
    """L09"""
    rows = t("labels").join(t("documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumns(
        {"score": F.col("quality") * 3, "propositions": F.when(F.col("lang") == "en", F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")), "replaced": F.col("toxic") == 1}
    )
    return V.gated_passages(rows, "score", "propositions", "replaced", "n_chars", "doc_id").select("doc_id", "score", "n_propositions", "rank")


@query(
    "source_contexts",
    "SELECT conv_id, count(*) AS n_sources, md5(string_agg('[S' || n || '] ' || role || chr(10) || CASE WHEN length(text) <= 1400 THEN text ELSE rtrim(left(text, 1400)) || '...' END, chr(10) || chr(10) ORDER BY n)) AS context_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id",
)
def source_contexts(t):
    """L12"""
    made = V.source_blocks(t("conversations"), "conv_id", "turn", "role", "text")
    return made.select("conv_id", "n_sources", F.md5("context").alias("context_md5"))


@query("retryable_events", "SELECT event_id, user_id % 3 = 0 AS retry, CASE WHEN user_id % 3 = 0 THEN 30.5::DOUBLE WHEN user_id % 3 = 1 THEN 180.0::DOUBLE ELSE least(90.0::DOUBLE, power(2.0::DOUBLE, event_id % 10)) END AS wait FROM events")
def retryable_events(t):
    """F11, L22, N27"""
    k = F.col("user_id") % 3
    rows = t("events").select("event_id", F.when(k == 0, 429).otherwise(400).alias("status"), F.when(k == 0, "30.5").alias("after"), F.when(k == 1, "5m2.5s").alias("reset"), (F.col("event_id") % 10).alias("attempt"))
    return rows.select("event_id", V.retryable("status").alias("retry"), V.retry_wait(F.col("after"), F.col("reset"), F.lit("none"), F.col("attempt")).alias("wait"))


SIGNALS = [("bank_loan", ("loan", "bank")), ("family", ("the", "de")), ("property", ("und", "que"))]


@query("signal_targets", "SELECT conv_id, turn, target FROM (SELECT conv_id, turn, unnest([CASE WHEN contains(x, 'loan') OR contains(x, 'bank') THEN 'bank_loan' END, CASE WHEN contains(x, 'the') OR contains(x, 'de') THEN 'family' END, CASE WHEN contains(x, 'und') OR contains(x, 'que') THEN 'property' END]) AS target FROM (SELECT *, lower(text) AS x FROM conversations)) WHERE target IS NOT NULL")
def signal_targets(t):
    """L08, F13"""
    rows = t("conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return V.signal_targets(rows, "k", "text", SIGNALS).select("k.conv_id", "k.turn", "target")


@query("hypothesis_queries", None)
def hypothesis_queries(t):
    """L07"""
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat("text", F.when(F.col("turn") == 1, F.lit(" section 5")).otherwise("")))).alias("q"), F.array_sort(F.collect_list("role")).alias("c"))
    return V.hypothesis_queries(rows, "conv_id", "q", "c").select("conv_id", F.size("queries").alias("n_queries"), F.array_join("concepts", ",").alias("concepts"))


@query("anchor_exact", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')))")
def anchor_exact(t):
    """Benchmark texts that a document holds; both sides meet on the text's rarest inner token."""
    docs = t("documents").select("doc_id", T.match_text("text").alias("t"))
    items = t("benchmark").select("item_id", T.match_text("text").alias("p")).where("p <> ''")
    n = F.size(F.split("p", " "))
    inner = F.slice(F.split("p", " "), 2, n - 2)
    tokens = items.where(n > 2).select("item_id", F.explode(F.array_distinct(inner)).alias("k"))
    seen = docs.select("doc_id", F.explode_outer(F.array_distinct(F.split("t", " "))).alias("k"))
    counts = seen.join(tokens.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(counts, "k", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k"))["k"].alias("k"))
    met = seen.join(rare, "k").select("doc_id", "item_id")
    held = met.join(docs, "doc_id").join(items, "item_id").where(F.contains("t", "p")).select("doc_id", "item_id")
    # texts of one or two words have no inner token: every document is searched for them
    return held.union(docs.join(F.broadcast(items.where(n <= 2)), F.contains("t", "p")).select("doc_id", "item_id"))


@query("anchor_fuzzy", None)
def anchor_fuzzy(t):
    """Anchors are conversation texts with a word left out; sources the texts."""
    rows = t("conversations").select("conv_id", "turn", "text", F.regexp_replace("text", r"^(\S+\s+\S+\s+)\S+\s+", "$1").alias("anchor"))
    return rows.select("conv_id", "turn", V.resolved_anchor("text", "anchor", F.lit("")).alias("resolved"))


@query("json_recover", None)
def json_recover(t):
    """Arrays around each turn, fenced, wrapped in prose or cut off."""
    item = F.to_json(F.struct(F.concat(F.lit("D"), "turn").alias("source_id"), F.col("text").alias("reason"), F.lit("2/3").alias("score")))
    whole = F.concat(F.lit('{"results": ['), item, F.lit(", "), item, F.lit("]}"))
    k = F.col("turn") % 4
    broken = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), whole, F.lit(" done"))).otherwise(F.concat(F.lit('{"results": ['), item, F.lit(', {"source_id": "D9", "rea')))
    found = t("conversations").select("conv_id", "turn", J.recover("results")(broken).alias("r"))
    first = F.get("r.items", F.lit(0))
    return found.select("conv_id", "turn", F.size("r.items").alias("n"), "r.partial", F.get_json_object(first, "$.source_id").alias("first_id"), J.score(F.get_json_object(first, "$.score")).alias("score"))


@query("rolling_limiter", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls FROM events")
def rolling_limiter(t):
    """Calls of a user in the last minute."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy(micros).rangeBetween(-60_000_000, 0)).alias("calls"))


@query("event_log_ids", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS log_id FROM events")
def event_log_ids(t):
    """V03"""
    return t("events").select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("log_id"))


@query("incremental_dedupe", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def incremental_dedupe(t):
    """What a run that takes a new half and skips the known keys adds up to: the first event of each key."""
    e = t("events").select("user_id", "event_type", "event_id")
    middle = e.agg(F.percentile_approx("event_id", 0.5).alias("m"))
    halves = e.crossJoin(F.broadcast(middle))  # one row
    first = lambda df: df.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    done = first(halves.where("event_id <= m"))
    fresh = first(halves.where("event_id > m")).join(done, ["user_id", "event_type"], "left_anti")
    return done.unionByName(fresh)


@query("session_windows", None)
def session_windows(t):
    """V02 (extra): sessions of a user, closed after ten idle minutes."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
