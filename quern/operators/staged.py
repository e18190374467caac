"""Model steps in stages: what a model fails at goes to the next try or the next model, and every attempt is kept.

A model is a function from a table of requests to a table with an answer for some or all of them. A gate says what is wrong
with an answer. Rows that pass leave; rows whose problem may pass by itself (a rate limit, a time-out) are tried again
with the same model, others go to the next one. What no model answers ends in the dead letters. Each stage is written
before the next begins, so a lost executor repeats one stage, and no accepted answer is asked for again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.repair import parsed
from quern.sources.scratch import Scratch

# Queries of a plan, states of an intake, and statuses that are worth another try.
PLAN_QUERIES = 4
INTAKE_STATES = ("ASK", "READY")
RETRYABLE = (408, 409, 429, 498, 500, 502, 503, 504)


@dataclass(frozen=True)
class Stage:
    """A model and how often it may be tried; `ask` takes (key, request, attempt) and returns (key, answer, status)."""

    name: str
    ask: Callable[[DataFrame], DataFrame]
    tries: int = 1


@dataclass(frozen=True)
class Outcome:
    """Accepted answers (key, request, model, attempts, answer), all attempts (key, model, attempt, problem), and dead letters (key, request, attempts, problem)."""

    answers: DataFrame
    attempts: DataFrame
    dead: DataFrame


def plan_queries(answer: Column) -> Column:
    """The trimmed queries of an answer's `queries` array; null where it is no JSON object with one."""
    found = F.try_variant_get(parsed(answer), "$.queries", "array<string>")
    return F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))


def plan_problem(answer: Column) -> Column:
    """What is wrong with a plan; null for exactly four different queries."""
    queries = plan_queries(answer)
    distinct = F.size(F.array_distinct(F.transform(queries, F.lower)))
    return F.when(queries.isNull(), "no queries").when(distinct != PLAN_QUERIES, F.concat(distinct.cast("string"), F.lit(" queries"))).when(F.size(queries) != PLAN_QUERIES, "repeated queries")


def intake_problem(answer: Column) -> Column:
    """What is wrong with an intake; null for a status of ASK with a question, or READY."""
    tree = parsed(answer)
    state, question = F.upper(F.trim(F.try_variant_get(tree, "$.status", "string"))), F.trim(F.try_variant_get(tree, "$.question", "string"))
    return F.when(state.isNull(), "no status").when(~state.isin(*INTAKE_STATES), F.concat(F.lit("status "), state)).when((state == "ASK") & (F.coalesce(question, F.lit("")) == ""), "no question")


def run_stages(requests: DataFrame, stages: list[Stage], problem: Callable[[Column], Column], scratch: Scratch | None = None) -> Outcome:
    """(key, request) through the stages in order.

    A row that a model leaves out counts as `no answer`; a status of 400 and more is a problem whatever the answer, and one of
    RETRYABLE is tried again by the same model while it has tries. Answers that a model gives twice count once, the smallest first.
    Keys must not be null or repeat.
    """
    scratch = scratch or Scratch(requests.sparkSession, "stages")
    waiting = scratch.cut(requests.select("key", "request", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("problem")), "requests")
    accepted = attempts = None
    join = lambda old, new: new if old is None else old.unionByName(new)
    for stage in stages:
        now, given_up = waiting, None
        for k in range(stage.tries):
            asked = now.select("key", "request", (F.col("attempts") + 1).alias("attempt"))
            got = stage.ask(asked).groupBy(F.col("key").alias("k")).agg(F.min(F.struct("status", "answer")).alias("g"))
            status, answer = F.col("g.status"), F.col("g.answer")
            wrong = F.when(F.col("k").isNull(), "no answer").when(status >= 400, F.concat(F.lit("status "), status.cast("string"))).otherwise(problem(answer))
            judged = now.join(got, F.col("key") == F.col("k"), "left").select(
                "key", "request", (F.col("attempts") + 1).alias("attempts"), answer.alias("answer"), wrong.alias("problem"), F.coalesce(status.isin(*RETRYABLE), F.lit(False)).alias("again")
            )
            judged = scratch.cut(judged, f"{stage.name}-{k + 1}")
            attempts = join(attempts, judged.select("key", F.lit(stage.name).alias("model"), F.col("attempts").alias("attempt"), "problem"))
            accepted = join(accepted, judged.where("problem is null").select("key", "request", F.lit(stage.name).alias("model"), "attempts", "answer"))
            left = judged.where("problem is not null")
            given_up = join(given_up, left.where("not again" if k + 1 < stage.tries else "true").select("key", "request", "attempts", "problem"))
            now = left.where("again").select("key", "request", "attempts", "problem")
        waiting = scratch.cut(given_up, "waiting")
    return Outcome(accepted, attempts, waiting)
