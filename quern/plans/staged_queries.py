"""Model steps with planted models: each turn's number decides what the models answer, so SQL can state every outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import staged as G
from quern.plans.registry import query

FOUR = "'{\"queries\":[\"a ' || key || '\",\"b\",\" c\",\"d\"]}'"
#: By turn % 6, the first model: a good plan; a rate limit, then a good plan; three queries; a server error at every try; prose; no answer at all.
FIRST = f"CASE kind WHEN 0 THEN {FOUR} WHEN 1 THEN {FOUR} WHEN 2 THEN '{{\"queries\":[\"a\",\"b\",\"c\",\"C\"]}}' WHEN 4 THEN 'I would search for it' END"
FIRST_STATUS = "CASE kind WHEN 1 THEN CASE WHEN attempt = 1 THEN 429 ELSE 200 END WHEN 3 THEN 503 ELSE 200 END"
#: The second model plans for kinds 2 and 3, and fails at the others.
SECOND = f"CASE WHEN kind IN (2, 3) THEN {FOUR} ELSE '{{}}' END"


def _model(answer: str, status: str, leaves_out: str = "false"):
    def ask(requests):
        return requests.withColumn("kind", F.expr("cast(substring_index(key, '-', -1) as int) % 6")).where(f"not ({leaves_out})").selectExpr("key", f"{answer} AS answer", f"{status} AS status")

    return ask


def _outcome(t):
    rows = t("conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("request")).select(F.concat_ws("-", "conv_id", "turn").alias("key"), "request")
    stages = [G.Stage("first", _model(FIRST, FIRST_STATUS, "kind = 5"), 2), G.Stage("second", _model(SECOND, "200"))]
    return G.run_stages(rows, stages, G.plan_problem)


KEYS = "SELECT DISTINCT conv_id || '-' || turn AS key, turn % 6 AS kind FROM conversations"


@query(
    "staged_plans",
    f"""SELECT key, CASE WHEN kind IN (0, 1) THEN 'first' WHEN kind IN (2, 3) THEN 'second' END AS model, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS attempts, CASE WHEN kind >= 4 THEN 'no queries' END AS problem,
      CASE WHEN kind < 4 THEN 'a ' || key || '|b|c|d' END AS queries FROM ({KEYS})""",
)
def staged_plans(t):
    """L03, L18, F11"""
    found = _outcome(t)
    good = found.answers.select("key", "model", "attempts", F.lit(None).cast("string").alias("problem"), F.array_join(G.plan_queries(F.col("answer")), "|").alias("queries"))
    return good.union(found.dead.select("key", F.lit(None).cast("string"), "attempts", "problem", F.lit(None).cast("string")))


@query(
    "stage_attempts",
    f"""SELECT model, problem, count(*) AS n FROM (SELECT 'first' AS model, unnest(CASE kind WHEN 0 THEN [NULL] WHEN 1 THEN ['status 429', NULL] WHEN 2 THEN ['3 queries'] WHEN 3 THEN ['status 503', 'status 503'] WHEN 4 THEN ['no queries'] ELSE ['no answer'] END) AS problem FROM ({KEYS})
      UNION ALL SELECT 'second', CASE WHEN kind >= 4 THEN 'no queries' END FROM ({KEYS}) WHERE kind >= 2) GROUP BY model, problem""",
)
def stage_attempts(t):
    """What each model's attempts came to."""
    return _outcome(t).attempts.groupBy("model", "problem").agg(F.count(F.lit(1)).alias("n"))


INTAKE = """CASE turn % 6 WHEN 0 THEN '{"status":"ready"}' WHEN 1 THEN '{"status":" ASK ","question":"what of turn ' || turn || '?"}' WHEN 2 THEN '{"status":"ASK","question":" "}' WHEN 3 THEN '{"status":"DONE"}' WHEN 4 THEN 'READY' ELSE '{"question":"q"} {"status":"READY"}' END"""


@query("intake_gate", "SELECT conv_id, turn, CASE turn % 6 WHEN 2 THEN 'no question' WHEN 3 THEN 'status DONE' WHEN 4 THEN 'no status' WHEN 5 THEN 'no status' END AS problem FROM conversations")
def intake_gate(t):
    """L02"""
    return t("conversations").selectExpr("conv_id", "turn", f"{INTAKE} AS answer").select("conv_id", "turn", G.intake_problem(F.col("answer")).alias("problem"))
