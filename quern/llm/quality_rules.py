"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a Spark expression over the whole text: lengths, symbol, stop-word and line ratios and
repetition inside a document. `let` binds a value once (a lambda over a one-element array), so the words
are split once per row however many measures read them. There is no shuffle and no user function.

Two 5-word windows count as equal if their 64-bit hashes are equal.

Defined results: a null or empty text has no words and fails `n_words`. Rows are judged one by one, so
repeated rows and ties get the same verdict each. Other columns of the input pass through `keep_good`
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or at from have not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et des en un du une que est pour qui dans par plus pas au sur "
    "el los del las por con una su para es al lo como más pero sus se no"
).split()

#: name, measure, lowest and highest value that passes (None: open). Measures are named in MEASURES.
THRESHOLDS = (
    ("n_words", "n_words", 10, None),
    ("repeat_words", "repeat_ratio", None, 0.20),
    ("mean_word_chars", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("dup_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("stop_words", "stop_ratio", 0.05, None),
)

SPACE = r"[ \t\n\x0B\f\r]"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and `body` with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str, size: int = 5) -> str:
    """Words that lie in windows of `size` words found twice or more."""
    ahead = ", ".join(f"{words}[i + {k}]" for k in range(1, size))
    hashes = f"transform(slice({words}, 1, size({words}) - {size - 1}), (x, i) -> xxhash64(x, {ahead}))"
    twice = "filter(transform(s, (e, k) -> if((k > 0 and s[greatest(k - 1, 0)].x = e.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = e.x), e.i, -1)), p -> p >= 0)"
    covered = f"aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least({size}, p[least(k + 1, size(p) - 1)] - x), {size})), 0, (a, x) -> a + x)"
    count = let(
        hashes,
        "h",
        "if(size(array_distinct(h)) = size(h), 0, "
        + let("array_sort(transform(h, (x, i) -> struct(x as x, i as i)))", "s", let(f"array_sort({twice})", "p", covered))
        + ")",
    )
    return f"if(size({words}) < {size}, 0, {count})"


def measures(text: str) -> str:
    """SQL for a struct of the counts of one text."""
    some = _sql(r"[^ \t\n\x0B\f\r]")
    stops = ", ".join(sorted({_sql(w) for w in STOP_WORDS}))
    lines = f"filter(split(t, '\\n'), l -> l rlike {some})"
    from_lines = let(
        lines,
        "ls",
        "struct(cast(size(ls) as bigint) as n_lines, cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines, "
        f"cast(size(filter(ls, l -> l rlike {_sql('^' + SPACE + '*[-*•]' + SPACE)})) as bigint) as n_bullet_lines, "
        f"cast(size(filter(ls, l -> l rlike {_sql('(\\.\\.\\.|…)' + SPACE + '*$')})) as bigint) as n_ellipsis_lines)",
    )
    from_words = let(
        f"array_remove(split(t, {_sql(SPACE + '+')}), '')",
        "w",
        "struct(cast(size(w) as bigint) as n_words, cast(char_length(array_join(w, '')) as bigint) as word_chars, "
        f"cast({_repeated('w')} as bigint) as n_repeat_words, "
        f"cast(size(filter(w, x -> lower(x) in ({stops}))) as bigint) as n_stop_words)",
    )
    symbols = f"cast(char_length(t) - char_length(regexp_replace(t, {_sql('[#*$%&|<>]')}, '')) as bigint)"
    return let(f"coalesce({text}, '')", "t", f"struct({from_words} as w, {from_lines} as l, {symbols} as n_symbols)")


def _ratio(top: str, bottom: str) -> str:
    return f"if({bottom} > 0, cast({top} as double) / {bottom}, 0.0D)"


#: What thresholds may name, as SQL over the struct m of counts.
MEASURES = {
    "n_words": "m.w.n_words",
    "n_lines": "m.l.n_lines",
    "repeat_ratio": _ratio("m.w.n_repeat_words", "m.w.n_words"),
    "mean_word_chars": _ratio("m.w.word_chars", "m.w.n_words"),
    "symbol_ratio": _ratio("m.n_symbols", "m.w.n_words"),
    "dup_line_ratio": _ratio("m.l.n_dup_lines", "m.l.n_lines"),
    "bullet_line_ratio": _ratio("m.l.n_bullet_lines", "m.l.n_lines"),
    "ellipsis_line_ratio": _ratio("m.l.n_ellipsis_lines", "m.l.n_lines"),
    "stop_ratio": _ratio("m.w.n_stop_words", "m.w.n_words"),
}


def _failing(measure: str, low, high) -> str:
    """SQL that is true where a rule fails."""
    x = MEASURES[measure]
    bounds = [f"{x} < {low}"] * (low is not None) + [f"{x} > {high}"] * (high is not None)
    return "(" + (" or ".join(bounds) or "false") + ")"


def passes(text: str, thresholds=THRESHOLDS) -> Column:
    """Whether a text column passes every rule: one expression, so that a filter evaluates the counts once."""
    good = " and ".join(f"not {_failing(*rule[1:])}" for rule in thresholds) or "true"
    return F.expr(let(measures(f"`{text}`"), "m", good))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: its counts, ratios, the names of the rules it fails, and `kept`."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.expr(measures(f"`{text_col}`")).alias("m"))
    failed = F.array_compact(F.array(*(F.when(F.expr(_failing(*rule[1:])), F.lit(rule[0])) for rule in thresholds)))
    return counted.select(
        "doc_id",
        *(F.col(f"m.w.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")),
        *(F.col(f"m.l.{c}").alias(c) for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")),
        F.col("m.n_symbols").alias("n_symbols"),
        *(F.expr(sql).alias(name) for name, sql in MEASURES.items() if name.endswith(("ratio", "chars"))),
        failed.alias("failed_rules"),
        (F.size(failed) == 0).alias("kept"),
    )


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    """The report with the contract's columns first."""
    report = quality_report(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.where(passes(text_col, thresholds))
