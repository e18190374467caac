"""Deterministic gates around model output: anchors, verdicts, audits, routing. The model is a function that the caller passes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQUENCE, COVERAGE, LEAST_SEQUENCE = 0.72, 0.78, 0.45


# ---- anchors


def _norm(x: str | None) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", (x or "").lower()))


# Weights of the sequence ratio, of the anchor's tokens and of the proposition's tokens.
SEQUENCE_WEIGHT, COVERAGE_WEIGHT, SUPPORT_WEIGHT = 0.52, 0.38, 0.10
# Fixed value of difflib: characters of the second text from which on it skips frequent letters.
SKIPPING = 200


def ordered_coverage(needle: list[str], hay: list[str]) -> float:
    """The share of tokens met in order, up to the first that is not."""
    at = n = 0
    for token in needle:
        try:
            at = hay.index(token, at) + 1
        except ValueError:
            break
        n += 1
    return n / len(needle) if needle and hay else 0.0


def _clauses(text: str | None) -> dict[str, str]:
    """The clauses of a text with what _norm makes of them."""
    flat = " ".join((text or "").split())
    parts = {p: _norm(p) for p in (" ".join(x.split()) for x in re.split(r"(?<=[.?!;:])\s+|\s+[–—]\s+", flat))}
    found = {p: own for p, own in parts.items() if len(own.split()) >= 3}
    own = _norm(flat)
    if flat and len(own.split()) <= 80:
        found.setdefault(flat, own)
    return found


def clauses(text: str) -> list[str]:
    """Clauses of three tokens and more, in order; a text of up to 80 tokens is one as well."""
    return list(_clauses(text))


def _close(covered: float, sequence: float) -> bool:
    return sequence >= SEQUENCE or (covered >= COVERAGE and sequence >= LEAST_SEQUENCE)


def _total(sequence: float, covered: float, support: float) -> float:
    return SEQUENCE_WEIGHT * sequence + COVERAGE_WEIGHT * covered + SUPPORT_WEIGHT * support


def _least_ratio(a: str, b: str) -> float:
    """What the sequence ratio reaches at least: its first block is no shorter than a common beginning or end, unless b is so long that it skips frequent letters."""
    if len(b) >= SKIPPING:
        return 0.0
    shared = max(len(commonprefix([a, b])), len(commonprefix([a[::-1], b[::-1]])))
    return 2.0 * shared / (len(a) + len(b))


def resolve_anchor(source: str | None, anchor: str | None, proposition: str | None) -> str:
    """The anchor if the source holds it, else the source's closest clause if it is close enough, else ''.

    The sequence ratio costs the product of two lengths, so it is worked out only for clauses that their lengths do not rule out.
    """
    source, anchor, proposition = (" ".join((x or "").split()) for x in (source, anchor, proposition))
    if not source:
        return ""
    if _norm(anchor) and _norm(anchor) in _norm(source):
        return anchor
    wanted = _norm(anchor) or _norm(proposition)
    tokens, extra = wanted.split(), set(_norm(proposition).split())
    if len(tokens) < 3:
        return ""
    asked = set(tokens)
    able, others = [], []
    for at, (clause, own) in enumerate(_clauses(source).items()):
        have = own.split()
        known = set(have)
        covered = max(ordered_coverage(tokens, have), len(asked & known) / len(asked))
        support = len(extra & known) / len(extra) if extra else 0.0
        most = 2.0 * min(len(wanted), len(own)) / (len(wanted) + len(own))
        # the first of equal totals wins, so places count down
        (able if _close(covered, most) else others).append(((_total(most, covered, support), -at), clause, own, covered, support))
    if not able:
        return ""
    able.sort(reverse=True)
    bound, clause, own, covered, support = able[0]
    least = _least_ratio(wanted, own)
    if _close(covered, least) and all(o[0] < (_total(least, covered, support), bound[1]) for o in (*able[1:], *others)):
        return clause

    def ratio(own: str) -> float:
        return SequenceMatcher(None, wanted, own).ratio()

    best, chosen, near = (0.0, 1), "", False
    for bound, clause, own, covered, support in able:
        if bound < best:
            break
        sequence = ratio(own)
        reached = (_total(sequence, covered, support), bound[1])
        if reached > best:
            best, chosen, near = reached, clause, _close(covered, sequence)
    # a clause that is not close enough itself still beats a close one of a smaller total
    beaten = (bound > best and (_total(ratio(own), covered, support), bound[1]) > best for bound, _, own, covered, support in others)
    return chosen if near and not any(beaten) else ""


def resolved_anchor(source, anchor, proposition) -> Column:
    """X18 as a column."""

    @F.pandas_udf("string")
    def run(source: pd.Series, anchor: pd.Series, proposition: pd.Series) -> pd.Series:
        return pd.Series([resolve_anchor(*row) for row in zip(source, anchor, proposition, strict=True)], dtype=object)

    return run(source, anchor, proposition)


# ---- scorers and their gates


def score_rows(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a caller's model, batch by batch; what it returns is data, judged by the gates below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)


def clamp(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    """An enum value in upper case, or the default."""
    up = F.upper(F.trim(x))
    return F.when(up.isin(*allowed), up).otherwise(default)


def with_defaults(candidates: DataFrame, results: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every candidate, with the model's row or the defaults; repeated results count once, by their smallest row."""
    columns = [c for c in results.columns if c != key]
    once = results.groupBy(key).agg(F.min(F.struct(*columns)).alias("r"))
    joined = candidates.join(once, key, "left")
    return joined.select(*candidates.columns, *(F.coalesce(F.col(f"r.{c}"), F.lit(defaults.get(c))).alias(c) for c in columns))


def accepted_analogies(scored: DataFrame, score: str, retrieval: str, key: str, least: int = 2, most: int = 5) -> DataFrame:
    """L04, L05, F08"""
    good = scored.withColumn(score, F.least(F.lit(3), F.greatest(F.lit(0), F.col(score))))
    return good.where(F.col(score) >= least).orderBy(F.desc(score), F.desc(retrieval), key).limit(most)


def judged_overall(*criteria: str) -> Column:
    """PASS only if all pass."""
    ok = None
    for c in criteria:
        this = F.coalesce(F.col(c) == "PASS", F.lit(False))
        ok = this if ok is None else ok & this
    return F.when(ok, "PASS").otherwise("FAIL")


def cleaned_claims(claims: DataFrame, valid: Column) -> DataFrame:
    """From (verdict, supported_by, safe_claim): unknown verdicts are UNSUPPORTED, unsupported claims lose their fields, support needs a valid source and a claim."""
    verdict = clamp(F.col("verdict"), ("SUPPORTED", "PARTIAL", "UNSUPPORTED"), "UNSUPPORTED")
    ids = F.array_intersect(F.coalesce("supported_by", F.array().cast("array<string>")), valid)
    claim = F.trim(F.coalesce("safe_claim", F.lit("")))
    verdict = F.when((F.size(ids) == 0) | (claim == ""), "UNSUPPORTED").otherwise(verdict)
    kept = verdict != "UNSUPPORTED"
    return claims.withColumns({"verdict": verdict, "supported_by": F.when(kept, ids).otherwise(F.array().cast("array<string>")), "safe_claim": F.when(kept, claim).otherwise("")})


def allowed_claims(claims: DataFrame) -> DataFrame:
    """L14"""
    return claims.where(F.col("verdict").isin("SUPPORTED", "PARTIAL") & (F.col("safe_claim") != "") & (F.size("supported_by") > 0))


def audit_passes(claims: DataFrame, key: str) -> DataFrame:
    """Per answer the verdict counts and whether it has claims and all are supported."""
    n = F.count(F.lit(1))
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    return claims.groupBy(key).agg(n.alias("claims"), count("SUPPORTED"), count("PARTIAL"), count("UNSUPPORTED"), F.bool_and(F.col("verdict") == "SUPPORTED").alias("passes"))


def fail_closed_answer(allowed: DataFrame, key: str, order: str) -> DataFrame:
    """The allowed claims as bullets with their sources."""
    line = F.concat(F.lit("- "), "safe_claim", F.lit(" ["), F.array_join("supported_by", "]["), F.lit("]"))
    rows = allowed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("r"))
    return rows.select(key, F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("answer"))


def invalid_citations(text: str, valid: Column) -> Column:
    """The cited source ids that do not exist."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1)))
    return F.array_sort(F.array_except(cited, valid))


def gated_passages(scored: DataFrame, score: str, propositions: str, replaced: str, retrieval: str, key: str, most: int = 6) -> DataFrame:
    """Scores of 2 and more need propositions whose anchors resolve; replaced law counts 1 at most, without propositions; the best `most` with a score of 2."""
    n = F.when(F.col(replaced), F.lit(0)).otherwise(F.size(propositions))
    top = F.when(F.col(replaced), F.least(F.col(score), F.lit(1))).when((F.col(score) >= 2) & (n == 0), F.lit(1)).otherwise(F.col(score))
    gated = scored.withColumns({score: top, "n_propositions": n})
    rank = F.row_number().over(Window.orderBy(F.desc(score), F.desc("n_propositions"), F.desc(retrieval), key))
    chosen = gated.where((F.col(score) >= 2) & (F.col("n_propositions") > 0)).withColumn("rank", rank).where(F.col("rank") <= most)
    return chosen.withColumn("proposition", F.get(propositions, F.lit(0)))


def source_blocks(sources: DataFrame, key: str, order: str, title: str, text: str, most: int = 1400) -> DataFrame:
    """The sources of a key as one numbered context."""
    from quern.functions.text import shorten

    numbered = sources.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    block = F.concat(F.lit("[S"), "n", F.lit("] "), title, F.lit("\n"), shorten(text, most))
    rows = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("r"))
    return rows.select(key, F.size("r").cast("long").alias("n_sources"), F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("context"))


def conversation_text(turns: DataFrame, key: str, turn: str, text: str) -> DataFrame:
    """The problem, then numbered answers."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))).alias("r"))
    lines = F.transform("r", lambda x, i: F.when(i == 0, F.concat(F.lit("Problem: "), x["x"])).otherwise(F.concat(i.cast("string"), F.lit(". "), x["x"])))
    return rows.select(key, F.array_join(lines, "\n").alias("conversation"))


def routed_samples(samples: DataFrame, question: str, answer: str, overall: str) -> DataFrame:
    """Adds `route`: error for short texts, accepted or rejected by the judge."""
    bad = (F.length(F.trim(question)) < 35) | (F.length(F.trim(answer)) < 80)
    return samples.withColumn("route", F.when(F.coalesce(bad, F.lit(True)), "errors").when(F.col(overall) == "PASS", "accepted").otherwise("rejected"))


RETRYABLE = (408, 409, 429, 498, 500, 502, 503, 504)


def retryable(status: str) -> Column:
    """F11"""
    return F.col(status).isNull() | F.col(status).isin(*RETRYABLE)


def retry_wait(retry_after: Column, reset: Column, message: Column, attempt: Column) -> Column:
    """The header's wait, else the reset's, else a hint in the message, else exponential; between 1 and 180 seconds (90 when exponential)."""
    from quern.functions.text import parse_duration

    hint = parse_duration(F.regexp_extract(message, r"(?i)try again in ([0-9hms.]+)", 1))
    given = F.coalesce(parse_duration(retry_after), parse_duration(reset), hint)
    grown = F.least(F.lit(90.0), F.pow(F.lit(2.0), attempt))
    return F.when(given.isNotNull(), F.least(F.lit(180.0), F.greatest(F.lit(1.0), given))).otherwise(grown)


def hypothesis_queries(raw: DataFrame, key: str, queries: str, concepts: str, most_queries: int = 4, most_concepts: int = 5) -> DataFrame:
    """Queries without provision numbers, concepts in order, a default label where none is left."""
    from quern.functions.text import collapse, distinct_ignoring_case, names_provision

    q = F.slice(F.filter(distinct_ignoring_case(F.transform(queries, lambda v: collapse(v))), lambda v: ~names_provision(v)), 1, most_queries)
    c = F.slice(distinct_ignoring_case(F.transform(concepts, lambda v: collapse(v))), 1, most_concepts)
    return raw.select(key, q.alias("queries"), F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("general"))).alias("concepts"))


def signal_targets(texts: DataFrame, key: str, text: str, rules: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """A target for every rule one of whose signals the text holds."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, signals)), lambda s: F.contains(low, s)), F.lit(name)) for name, signals in rules)))
    return texts.select(key, F.explode(hits).alias("target"))
