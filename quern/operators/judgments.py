"""Judgments in two layouts, read line by line.

A text is an array of lines, and every rule asks one question of a line: which label opens it, is it a body heading,
a versus line, a case number, a role label. Sections are slices between the lines that answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.scratch import Scratch

# Words of the two layouts, and limits.
LEGACY_LABELS = ("PETITIONER", "RESPONDENT", "BENCH", "CITATION", "ACT", "HEADNOTE", "JUDGMENT")  # a colon follows
DATE_LABEL = "DATE OF JUDGMENT"  # with a colon or without
DATE_LABELS = ("DATE OF JUDGMENT", "DATE OF DECISION", "PRONOUNCED ON", "DATE OF PRONOUNCEMENT", "DECIDED ON")
BODY_HEADINGS = ("JUDGMENT", "ORDER")
VERSUS = ("VERSUS", "VS", "VS.", "V", "V.")
CASE_KINDS = ("CIVIL", "CRIMINAL", "WRIT", "TRANSFER", "SPECIAL LEAVE", "REVIEW", "CURATIVE", "CONTEMPT", "MISCELLANEOUS")
ROLES = ("APPELLANT", "RESPONDENT", "PETITIONER", "APPLICANT")
CORAM, CORAM_STOPS = "CORAM", ("FOR THE", "APPEARANCES", "COUNSEL", "JUDGMENT", "ORDER", "DATE OF JUDGMENT")
AUTHOR_MARKS = ("J", "CJ", "CJI", "JUDGE")
PETITIONER_LIMIT, MODERN_BODY_LIMIT, MODERN_HEADER, AUTHOR_LIMIT, CASE_LIMIT, DATE_LIMIT, CORAM_LINES, USABLE = 12_000, 15_000, 12_000, 700, 140, 100, 10, 300


def _let(value: Column, body) -> Column:
    """What `body` makes of a value that is made once, wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- what a line is


def _plain(line: Column) -> Column:
    """Upper case, single blanks, none at the ends."""
    return F.upper(F.btrim(F.regexp_replace(line, r"[ \t]+", " ")))


def _label(line: Column, labels: tuple[str, ...]) -> Column:
    """The label of the list that opens the line, a colon after it; null where none does."""
    return F.when(line.contains(":"), _let(_plain(F.substring_index(line, ":", 1)), lambda head: F.when(head.isin(*labels), head)))


def _is_dated(line: Column) -> Column:
    """Whether the date label opens the line; most lines are told by their first letter."""
    return (F.upper(F.left(F.ltrim(line, F.lit(" \t")), F.lit(1))) == DATE_LABEL[0]) & _plain(line).startswith(DATE_LABEL)


def _after_colon(line: Column) -> Column:
    return F.btrim(F.substring(line, F.instr(line, F.lit(":")) + 1, F.length(line)))


def legacy_label(line: Column) -> Column:
    return F.coalesce(_label(line, LEGACY_LABELS), F.when(_is_dated(line), F.lit(DATE_LABEL)))


def _legacy_value(line: Column) -> Column:
    """What stands behind the label on its own line."""
    short = F.btrim(F.regexp_replace(line, r"[ \t]+", " "))
    dated = F.ltrim(F.substring(short, len(DATE_LABEL) + 1, F.length(short)))
    return F.when(_label(line, LEGACY_LABELS).isNull(), F.when(dated.startswith(":"), F.substring(dated, F.lit(2), F.length(dated))).otherwise(dated)).otherwise(_after_colon(line))


def is_body_heading(line: Column) -> Column:
    """A heading may be spaced out, and may end with one colon or full stop."""
    letters = F.replace(_plain(line), F.lit(" "), F.lit(""))
    bare = F.when(F.right(letters, F.lit(1)).isin(":", "."), F.left(letters, F.length(letters) - 1)).otherwise(letters)
    return bare.isin(*BODY_HEADINGS)


def is_versus(line: Column) -> Column:
    return _plain(line).isin(*VERSUS)


def is_case_number(line: Column) -> Column:
    """A kind of case, and at most CASE_LIMIT characters later the word NO or NOS with something behind it."""
    plain = _plain(line)
    rest = F.coalesce(*(F.when(plain.startswith(kind), F.substring(plain, F.lit(len(kind) + 1), F.length(plain))) for kind in CASE_KINDS))
    return F.regexp_instr(rest, F.lit(r"\bNOS?\b[ .:-]*[A-Z0-9]")).between(1, CASE_LIMIT + 1)


def is_role(line: Column) -> Column:
    """A role label alone on its line, dots or dashes before it allowed."""
    word = F.regexp_replace(F.regexp_replace(_plain(line), r"^[.…–— -]+", ""), r" ?\( ?S ?\)$|S$", "")
    return word.isin(*ROLES)


# ---- positions and slices; positions start at 1, and none is null


def _first(lines: Column, test) -> Column:
    found = F.array_position(F.transform(lines, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(True)).cast("int")
    return F.nullif(found, F.lit(0))


def _from(lines: Column, start: Column) -> Column:
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def _until(lines: Column, stop: Column) -> Column:
    """Lines before `stop`, all where it is null."""
    return F.when(stop.isNull(), lines).otherwise(F.slice(lines, F.lit(1), stop - 1))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _cleaned(lines: Column) -> Column:
    return T.clean_judgment(_joined(lines))


def _start(lines: Column, at: Column) -> Column:
    """The characters before a line."""
    return F.when(at == 1, F.lit(0)).otherwise(F.length(_joined(F.slice(lines, F.lit(1), at - 1))) + 1)


# ---- fields


def first_page(raw: Column) -> Column:
    """Pages end with a form feed; a text without one is a single page."""
    return F.substring_index(raw, "\f", 1)


def is_legacy(raw: Column) -> Column:
    """The first page labels a petitioner and a judgment date."""
    lines = F.split(T.line_feeds(first_page(raw)), "\n")
    return F.exists(lines, lambda v: F.coalesce(_label(v, ("PETITIONER",)).isNotNull(), F.lit(False))) & F.exists(lines, _is_dated)


def labelled_fields(header: Column) -> Column:
    """Map from label to its texts, a line each, over lines that open with a label."""
    numbered = F.transform(header, lambda v, i: F.struct((i + 1).alias("at"), legacy_label(v).alias("label"), _legacy_value(v).alias("value")))
    last = F.size(header) + 1

    def pieces(marks: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(marks, k + 1)["at"], last)
        text = lambda m, k: T.clean_judgment(F.concat(m["value"], F.lit("\n"), _joined(F.slice(header, m["at"] + 1, ends(k) - m["at"] - 1))))
        return F.transform(marks, lambda m, k: F.struct(m["label"].alias("label"), text(m, k).alias("text")))

    wanted = [x for x in (*LEGACY_LABELS, DATE_LABEL) if x != "JUDGMENT"]

    def by_label(found: Column) -> Column:
        texts = lambda label: _joined(F.transform(F.filter(found, lambda p: (p["label"] == label) & (p["text"] != "")), lambda p: p["text"]))
        return F.create_map(*(c for x in wanted for c in (F.lit(x), texts(x))))

    return _let(F.filter(numbered, lambda m: m["label"].isNotNull()), lambda marks: _let(pieces(marks), by_label))


def explicit_date(header: Column) -> Column:
    """The first date that can be read behind a date label on its line."""

    def dated(line: Column) -> Column:
        rest = _let(F.btrim(F.regexp_replace(line, r"[ \t]+", " ")), lambda plain: F.coalesce(*(F.when(F.upper(plain).startswith(x), F.substring(plain, F.lit(len(x) + 1), F.lit(DATE_LIMIT))) for x in DATE_LABELS)))
        words = F.filter(F.transform(F.split(rest, "[ :]+"), lambda v: F.regexp_replace(v, r"^[,.(]+|[,.)]+$", "")), lambda v: v != "")
        # a date is one word (12.10.2015), or three with the month second or first
        three = lambda w, i: F.concat_ws(" ", F.get(w, i), F.when(F.get(w, i).rlike("^[A-Za-z]"), F.concat(F.get(w, i + 1), F.lit(","))).otherwise(F.get(w, i + 1)), F.get(w, i + 2))
        read = lambda w: F.array_compact(F.transform(w, lambda v, i: F.coalesce(_let(v, T.parse_date), _let(three(w, i), T.parse_date))))
        return F.get(_let(words, read), F.lit(0))

    return F.get(F.array_compact(F.transform(header, dated)), F.lit(0))


def parties(header: Column) -> Column:
    """(petitioner, respondent, case_number) around the first versus line; empty without one, or without a case number before it."""
    last_word = lambda v: T.strip(T.sub(v, r"(?i)\s+\b(?:versus|vs|v)\.?\s*$", ""))

    def around(versus: Column, case: Column) -> Column:
        found = versus.isNotNull() & case.isNotNull()
        above = F.slice(header, F.lit(1), versus - 1)
        right = lambda below: T.clean_party(_joined(_until(below, _first(below, is_role))))
        return F.struct(
            F.when(found, last_word(T.clean_party(_joined(_from(above, case + 1))))).otherwise("").alias("petitioner"),
            F.when(found, _let(_from(header, versus + 1), right)).otherwise("").alias("respondent"),
            F.when(found, T.clean_judgment(F.element_at(header, case))).alias("case_number"),
        )

    case = lambda versus: F.array_max(F.transform(F.slice(header, F.lit(1), versus - 1), lambda v, i: F.when(is_case_number(v), i + 1)))
    return _let(_first(header, is_versus), lambda versus: _let(case(versus), lambda place: around(versus, place)))


def coram(header: Column) -> Column:
    """Up to ten lines of an explicit coram block."""
    none = F.expr("cast(array() as array<string>)")

    def below(at: Column) -> Column:
        block = F.concat(F.array(_after_colon(F.element_at(header, at))), _from(header, at + 1))
        upto = _let(block, lambda b: _until(b, _first(b, lambda v: _label(v, CORAM_STOPS).isNotNull())))
        lines = F.filter(F.transform(upto, lambda v: T.clean_judgment(v)), lambda v: v != "")
        return F.when(at.isNull(), none).otherwise(F.slice(lines, F.lit(1), F.lit(CORAM_LINES)))

    return _let(_first(header, lambda v: _label(v, (CORAM,)).isNotNull()), below)


def author(body: Column) -> Column:
    """The first line near the body's start that ends with a comma and a judge's mark."""

    def named(line: Column) -> Column:
        bare = F.rtrim(F.regexp_replace(F.btrim(line), r"[ \t]*:$", ""))
        last = F.substring_index(bare, ",", -1)
        mark = F.replace(F.replace(F.upper(last), F.lit("."), F.lit("")), F.lit(" "), F.lit(""))
        return bare.contains(",") & mark.isin(*AUTHOR_MARKS) & (F.length(bare) - F.length(last) - 1).between(3, 120)

    written = lambda line: T.clean_judgment(F.regexp_replace(F.btrim(line), r"[ \t]*:$", ""))
    return _let(F.get(F.filter(F.split(F.left(body, F.lit(AUTHOR_LIMIT)), "\n"), named), F.lit(0)), written)


def parse_judgments(docs: DataFrame, key: str, raw: str, **carried: Column) -> DataFrame:
    """One record per judgment, by its layout, with flags and status, and what is carried along from its row."""
    # each step is written: its arrays of lines are asked many questions, and inlined they would be made anew for each
    scratch = Scratch(docs.sparkSession, "judgments")
    text = scratch.cut(docs.select(key, *(v.alias(k) for k, v in carried.items()), is_legacy(F.col(raw)).alias("legacy"), T.clean_judgment(F.replace(F.col(raw), F.lit("\f"), F.lit("\n"))).alias("t")), "text")
    lines = text.select("*", F.split("t", "\n").alias("lines"))
    ls, legacy = F.col("lines"), F.col("legacy")
    # where the header starts and the body's heading stands
    labelled = _first(ls, lambda v: _label(v, ("PETITIONER",)).isNotNull())
    from_label = F.when(_start(ls, labelled) < PETITIONER_LIMIT, labelled)
    placed = lines.withColumn("top", F.when(legacy, from_label).otherwise(F.lit(1)))
    below = _from(ls, F.col("top"))
    heading = F.when(legacy, _first(below, lambda v: _label(v, ("JUDGMENT",)).isNotNull())).otherwise(_first(ls, lambda v: (F.length(v) <= 24) & is_body_heading(v)))
    placed = placed.withColumn("at", heading + F.col("top") - 1)
    placed = placed.withColumn("at", F.when(legacy | (_start(ls, F.col("at")) < MODERN_BODY_LIMIT), F.col("at")))
    placed = scratch.cut(placed.drop("lines"), "placed").withColumn("lines", F.split("t", "\n"))
    scratch.drop(text)
    at, top = F.col("at"), F.col("top")
    on_line = F.when(legacy, _after_colon(F.element_at(ls, at))).otherwise("")
    head = F.when(legacy, F.slice(ls, top, F.coalesce(at, F.size(ls) + 1) - top)).when(at.isNotNull(), F.slice(ls, F.lit(1), at - 1)).otherwise(F.split(F.left("t", F.lit(MODERN_HEADER)), "\n"))
    # the lines below are clean
    body = F.when(at.isNull(), "").otherwise(T.strip(F.concat(T.clean_judgment(on_line), F.lit("\n"), _joined(_from(ls, at + 1)))))
    parts = placed.select(key, *carried, "legacy", F.coalesce(F.col("t") == "", F.lit(True)).alias("blank"), F.coalesce(head, F.expr("cast(array() as array<string>)")).alias("head"), body.alias("body"))
    parts = scratch.cut(parts, "parts")
    scratch.drop(placed)
    read = parts.withColumns({"old": F.when(legacy, labelled_fields(F.col("head"))), "new": F.when(~legacy, parties(F.col("head")))})
    old = lambda label: F.coalesce(F.col("old")[label], F.lit(""))
    last_word = lambda v: T.strip(T.sub(v, r"(?i)\s+\b(?:vs|v)\.?\s*$", ""))
    bench = F.when(legacy, T.distinct_ignoring_case(F.split(old("BENCH"), "\n"))).otherwise(coram(F.col("head")))
    fields = read.select(
        key,
        F.when(legacy, "legacy").otherwise("modern").alias("document_format"),
        F.coalesce(F.when(legacy, last_word(old("PETITIONER"))).otherwise(F.col("new.petitioner")), F.lit("")).alias("petitioner"),
        F.coalesce(F.when(legacy, old("RESPONDENT")).otherwise(F.col("new.respondent")), F.lit("")).alias("respondent"),
        F.when(legacy, T.parse_date(old(DATE_LABEL))).otherwise(explicit_date(F.col("head"))).alias("judgment_date"),
        F.coalesce(F.array_join(bench, "; "), F.lit("")).alias("bench"),
        F.when(~legacy, F.col("new.case_number")).alias("case_number"),
        F.when(~legacy, author(F.col("body"))).alias("judgment_author"),
        F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("body_characters"),
        F.coalesce("body", F.lit("")).alias("judgment_text"),
        "blank",
        (legacy & (F.size("head") == 0)).alias("odd"),
        *carried,
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("blank"), F.lit("no_extractable_text")),
            F.when(F.col("odd"), F.lit("unsupported_header_format")),
            F.when(F.col("body_characters") == 0, F.lit("missing_judgment_body")),
            F.when((F.col("document_format") == "modern") & F.col("case_number").isNull(), F.lit("missing_case_number")),
            F.when(F.col("petitioner") == "", F.lit("missing_petitioner")),
            F.when(F.col("respondent") == "", F.lit("missing_respondent")),
            F.when(F.col("judgment_date").isNull(), F.lit("missing_or_invalid_date")),
            F.when(F.col("bench") == "", F.lit("missing_bench")),
            F.when(F.col("body_characters").between(1, USABLE - 1), F.lit("short_judgment_body")),
        )
    )
    modern_title = F.when((F.col("petitioner") == "") & (F.col("respondent") != ""), F.col("respondent"))
    return fields.withColumns(
        {
            "title": F.coalesce(modern_title, T.case_title("petitioner", "respondent", F.lit("Untitled judgment"))),
            "quality_flags": F.array_join(flags, ","),
            "parse_status": F.when(F.size(flags) == 0, "parsed").otherwise("review_required"),
            "text_status": F.when(F.col("body_characters") >= USABLE, "usable").otherwise("review_required"),
        }
    ).drop("blank", "odd")


# Characters of the raw header, of the body's start and of its end in a report.
RAW_HEADER, BODY_START, BODY_END = 5000, 1200, 600
CHECKED = {"title": "Untitled judgment", "petitioner": "", "respondent": "", "judgment_date": None, "bench": "", "case_number": None, "judgment_author": None}


def review_report(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per judgment for a reader: the raw header beside the parsed fields, the body's start and end, and what is missing.

    The raw header ends before the first line labelled JUDGMENT, or after RAW_HEADER characters where there is none. `missing` lists the
    fields without a value; case number and author are asked of modern judgments alone. A null text gives a row with everything missing.
    """
    lines = F.split(T.line_feeds(F.coalesce(F.col(raw), F.lit(""))), "\n")
    at = lambda ls: _first(ls, lambda v: _label(v, ("JUDGMENT",)).isNotNull())
    header = _let(lines, lambda ls: _let(at(ls), lambda k: F.when(k.isNull(), F.left(_joined(ls), F.lit(RAW_HEADER))).otherwise(_joined(F.slice(ls, F.lit(1), k - 1)))))
    headnote = F.exists(F.split("raw_header", "\n"), lambda v: F.coalesce(_label(v, ("HEADNOTE",)).isNotNull(), F.lit(False)))
    parsed = parse_judgments(docs, key, raw, raw_header=header)
    modern = {"case_number", "judgment_author"}
    lost = (F.when((F.col(c).isNull() if empty is None else F.coalesce(F.col(c), F.lit("")) == empty) & ((F.col("document_format") == "modern") if c in modern else F.lit(True)), F.lit(c)) for c, empty in CHECKED.items())
    missing = F.array_compact(F.array(*lost, F.when(F.col("body_characters") == 0, F.lit("judgment_text"))))
    body = F.col("judgment_text")
    fields = [c for c in CHECKED]
    return parsed.select(
        key, "document_format", "raw_header", headnote.alias("headnote_in_source"), *fields, F.left(body, F.lit(BODY_START)).alias("body_start"), F.right(body, F.lit(BODY_END)).alias("body_end"), "quality_flags",
        F.array_join(missing, ",").alias("missing"),
    )
