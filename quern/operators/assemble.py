"""Records put together from several rows: merged scenarios, numbered and aligned tables, spans between expected headings, statute rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.scratch import Scratch


def numbered(df: DataFrame, keys: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Rows with their 0-based place in the order of the keys; tasks number their own range, so none sorts the whole table."""
    ranged = df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    placed = scratch.cut(ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*keys))), "placed")
    # one row for each partition
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__m")).withColumn("__first", F.sum("__m").over(Window.orderBy("__p")) - F.col("__m"))
    return placed.join(F.broadcast(sizes), "__p").withColumn(name, F.col("__i") + F.col("__first") - 1).select(*df.columns, name)


def merged_scenarios(df: DataFrame, order: str, text: str, statutes: str) -> DataFrame:
    """(scenario_id, scenario, statutes, n_rows), one row for each text whatever its case.

    The first row in `order` gives the spelling; statutes are the union of all rows' lists in order of first mention, also
    whatever their case; ids count in order of first mention. Rows without text or without statutes are left out.
    """
    labels = F.filter(F.transform(statutes, lambda x: T.collapse(x)), lambda x: x != "")
    rows = df.select(F.col(order).alias("o"), T.collapse(F.col(text)).alias("scenario"), labels.alias("labels")).where("scenario <> ''")
    # a row without labels explodes to none
    each = rows.select("o", "scenario", F.posexplode("labels").alias("at", "label"))
    once = each.groupBy(F.lower("scenario").alias("key"), F.lower("label").alias("low")).agg(
        F.min(F.struct("o", "at", "label")).alias("said"), F.min(F.struct("o", "scenario")).alias("told"), F.count_if(F.col("at") == 0).alias("n")
    )
    merged = once.groupBy("key").agg(F.min("told").alias("told"), F.sort_array(F.collect_list("said")).alias("said"), F.sum("n").alias("n_rows"))
    out = merged.select("told.o", "told.scenario", F.transform("said", lambda x: x["label"]).alias("statutes"), "n_rows")
    ided = numbered(out, ["o", "scenario"], "place", Scratch(df.sparkSession, "scenarios"))
    return ided.select(T.numbered_id("scenario_", F.col("place"), 6).alias("scenario_id"), "scenario", "statutes", "n_rows")


def aligned(records: DataFrame, record_key: str, vectors: DataFrame, vector_key: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """Record i with vector i, both in the order of their keys. Unequal counts raise, and so does a vector of other dimensions."""
    n, m = records.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} records but {m} vectors")
    if dimensions is not None and (bad := vectors.where(~F.coalesce(F.size(vector) == dimensions, F.lit(False))).count()):
        raise ValueError(f"{bad} vectors have not {dimensions} dimensions")
    scratch = Scratch(records.sparkSession, "aligned")
    left, right = numbered(records, [record_key], "place", scratch), numbered(vectors, [vector_key], "place", scratch)
    return left.join(right, "place")


def heading_spans(df: DataFrame, key: str, text: str, expected: list[tuple[str, str]]) -> DataFrame:
    """(key, number, start, stop, problem): the span of each expected heading up to the next one, 0-based in characters.

    Each heading must begin exactly one line, and they must come in the order given; a text in which they do not is one
    row with its problem and no span. A heading may stand in an amendment bracket, and its words may be set over lines.
    """
    found = []
    for number, heading in expected:
        words = r"\s+".join(map(re.escape, heading.split()))
        parts = F.split(F.coalesce(text, F.lit("")), rf"(?m)^[ \t]*(?:\d{{1,3}}\[)?{re.escape(number)}\.[ \t]*\[?{words}", -1)
        found.append(F.struct(F.lit(number).alias("number"), (F.size(parts) - 1).alias("n"), F.length(parts[0]).alias("start")))
    wrong = F.filter("found", lambda x: x["n"] != 1)
    starts = F.transform("found", lambda x: x["start"])
    problem = F.when(F.size(wrong) > 0, F.concat(wrong[0]["number"], F.lit(": found "), wrong[0]["n"])).when(F.array_sort(starts) != starts, F.lit("order"))
    stops = F.concat(F.slice(starts, 2, len(expected)), F.array(F.length(text)))
    spans = F.when(F.col("problem").isNull(), F.arrays_zip(F.transform("found", lambda x: x["number"]).alias("number"), starts.alias("start"), stops.alias("stop")))
    seen = df.select(key, text, F.array(*found).alias("found")).withColumn("problem", problem)
    return seen.select(key, "problem", F.explode_outer(spans).alias("s")).select(key, "s.number", "s.start", "s.stop", "problem")


def completion_rules(sources: DataFrame, session: str, order: str, most: int = 6) -> DataFrame:
    """(session, rule_id, proposition, scope_limit, title, source_id, verified): what statutes are searched for.

    Court sources (source_type, legal_score, verified, title, source_id, propositions of (proposition, scope_limit)) give
    rules in order, equal ones once. Verified sources go alone where they give any; else those of score 1 and more do.
    """
    usable = sources.where((F.col("source_type") == "supreme_court") & (F.col("verified") | (F.coalesce("legal_score", F.lit(0)) >= 1)))
    each = usable.select(session, order, "verified", "title", "source_id", F.posexplode("propositions").alias("at", "p"))
    told = each.withColumn("proposition", T.collapse(F.col("p.proposition"))).withColumn("same", T.match_text("proposition")).where("same <> ''")
    said = F.struct(order, "at", "proposition", T.collapse(F.coalesce("p.scope_limit", F.lit(""))).alias("scope_limit"), "title", "source_id")
    once = told.groupBy(F.col(session).alias("__of"), "verified", "same").agg(F.min(said).alias("__s"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("__of", "verified").orderBy("__s"))).where(F.col("rank") <= most)
    best = ranked.withColumn("any", F.max("verified").over(Window.partitionBy("__of"))).where("verified = any")
    return best.select(F.col("__of").alias(session), F.concat(F.lit("R"), "rank").alias("rule_id"), "__s.proposition", "__s.scope_limit", "__s.title", "__s.source_id", "verified")


def preliminary_sources(ranked: DataFrame, session: str, order: str, text: str, least: int = 1, most: int = 4) -> DataFrame:
    """The first passages of a session with text and the least score, for a cautious answer; what is no number scores 0."""
    score = F.coalesce(F.col("legal_score").try_cast("int"), F.lit(0))
    good = ranked.where((score >= least) & (T.collapse(F.coalesce(text, F.lit(""))) != ""))
    return good.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order))).where(F.col("place") <= most)


# ---- structured answers

#: A key that no answer holds.
_END = "__end_of_answer"


def answer_problem(answer: str, required: dict[str, str]) -> Column:
    """Null if the text is one JSON object with these keys, each of the kind that its JSON type name starts with ('' for any); else what is wrong."""
    value, keys = F.try_parse_json(answer), F.json_object_keys(answer)
    # the parser ignores what follows the first value, so the text must also stand as one member before another
    alone = F.json_object_keys(F.concat(F.lit('{"v":'), answer, F.lit(f',"{_END}":0}}'))) == F.array(F.lit("v"), F.lit(_END))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    out = F.when(value.isNull() | ~F.coalesce(alone, F.lit(False)), F.lit("no JSON")).when(keys.isNull(), F.lit("no object")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    for name, kind in required.items():
        if kind:
            own = F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
            out = out.when(~F.coalesce(F.startswith(own, F.lit(kind)), F.lit(False)), F.lit(f"type: {name}"))
    return out


def required_answers(answers: DataFrame, answer: str, required: dict[str, str], repair, strict: bool = False) -> DataFrame:
    """The rows with `repaired` and `problem`; what fails goes through repair(DataFrame) once, and is judged again.

    repair gets the failed rows and returns them with another answer. With strict, a row that fails twice raises.
    """
    judged = Scratch(answers.sparkSession, "answers").cut(answers.withColumn("problem", answer_problem(answer, required)), "judged")
    fine = judged.where("problem is null").withColumn("repaired", F.lit(False))
    again = repair(judged.where("problem is not null").drop("problem")).withColumn("problem", answer_problem(answer, required)).withColumn("repaired", F.lit(True))
    if strict:
        again = again.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("failed twice: "), "problem"))).otherwise(F.col("problem")))
    return fine.unionByName(again)
