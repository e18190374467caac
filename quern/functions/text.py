"""Text functions as Spark columns: cleaning, keys, headers, labels, counts. All run inside the JVM.

A column may be given by name or as a Column. Unless said otherwise a null gives a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
# Fixed value: the characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Words that carry no meaning for retrieval.
RETRIEVAL_STOP = (
    "the a an and or of to for in on by with from under where when whether what which that this is are be being been as "
    "act law legal india indian section article rule order provision provisions claim claims"
).split()

# File-name tags of languages.
LANGUAGE_TAGS = {
    "HIN": "Hindi", "TAM": "Tamil", "TEL": "Telugu", "MAL": "Malayalam", "KAN": "Kannada", "MAR": "Marathi", "GUJ": "Gujarati",
    "PUN": "Punjabi", "BEN": "Bengali", "ORI": "Odia", "ODI": "Odia", "ASS": "Assamese", "URD": "Urdu",
}

# Date layouts in the order in which they are tried.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "d-MMMM-yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy")


# Lines that the portal and the printer add, in any case.
BOILERPLATE = (r"https?://JUDIS\.NIC\.IN/?", r"Page[ \t]+\d+[ \t]+of[ \t]+\d+")

# Words that name a provision, or a section alone; each may end in s.
PROVISION_WORDS = ("section", "sec", "article", "order", "rule")
SECTION_WORDS = ("section", "sec")

# Role labels of parties, and the words that open a note on a case's origin.
ROLES = ("APPELLANT", "RESPONDENT", "PETITIONER", "APPLICANT")
ORIGIN_NOTE = "ARISING OUT OF"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x, pattern: str, to: str) -> Column:
    return F.regexp_replace(_c(x), F.lit(pattern), F.lit(to))


def strip(x) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(_c(x), F.lit(WHITE))


def line_feeds(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_corpus_text(x) -> Column:
    """Line ends, hard blanks, blanks before line ends, runs of blanks and of empty lines; null gives ''."""
    t = F.replace(line_feeds(F.coalesce(_c(x), F.lit(""))), F.lit(NBSP), F.lit(" "))
    # a run of blanks is tried from its first alone
    return strip(sub(sub(sub(t, r"[ \t](?<![ \t]{2})[ \t]*+\n", "\n"), r"[ \t]{2,}+", " "), r"\n{4,}", "\n\n\n"))


def clean_lines(x) -> Column:
    """Every line stripped at its end, at most one empty line in a row."""
    return strip(sub(sub(line_feeds(x), r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def clean_judgment(x) -> Column:
    """Portal and page-number lines go, blanks collapse, at most one empty line in a row."""
    t = F.replace(line_feeds(x), F.lit("\u0000"), F.lit(""))
    t = F.replace(sub(t, rf"(?im)^[ \t]*(?:{'|'.join(BOILERPLATE)})[ \t]*$", ""), F.lit("\t"), F.lit(" "))
    # one scan for both: a blank behind a blank goes, and a line end behind two
    return strip(sub(t, r"[ \n](?:(?<=  ) *+|(?<=\n{3})\n*+)", ""))


def collapse(x) -> Column:
    """White space of any kind becomes single blanks."""
    # only what is not a single blank is replaced, and blanks alone are left at the ends
    return F.trim(sub(x, r"(?U)\s{2,}|[^\S ]", " "))


def for_duplicates(x) -> Column:
    """Lower case, plain quotes and dashes, single blanks."""
    plain = F.lower(_c(x))
    # a mark that a text lacks costs a scan of it; collapse() turns hard blanks into blanks
    for mark, to in zip("‘’“”–—", "''\"\"--", strict=True):
        plain = F.replace(plain, F.lit(mark), F.lit(to))
    return collapse(plain)


def title_key(x) -> Column:
    """N06"""
    return collapse(sub(for_duplicates(x), r"[^a-z0-9 ]+", " "))


def match_text(x) -> Column:
    """N07"""
    return F.trim(sub(F.lower(_c(x)), r"[^a-z0-9]+", " "))


def act_key(x) -> Column:
    """Without a "last updated" tail and the word "the"."""
    t = sub(F.lower(_c(x)), r"\(?\s*last updated.*$", "")
    return F.trim(sub(sub(sub(t, r"[^a-z0-9]+", " "), r"\bthe\b", " "), r" +", " "))


def section_key(x) -> Column:
    """N09"""
    return F.trim(sub(sub(F.lower(_c(x)), r"\bsec(\.|\s)\s*", "section "), r"[^a-z0-9]+", " "))


def party_name(x) -> Column:
    """Null gives ''."""
    t = F.replace(F.upper(F.coalesce(_c(x), F.lit(""))), F.lit("&"), F.lit(" AND "))
    return F.trim(sub(sub(t, r"[^A-Z0-9 ]", " "), r" +", " "))


def question_key(x) -> Column:
    """N11"""
    return F.trim(sub(sub(F.lower(_c(x)), r"[^a-z0-9 ]", ""), r" +", " "))


def empty_to_null(x) -> Column:
    """N12"""
    return F.nullif(strip(x), F.lit(""))


def null_to_empty(x) -> Column:
    """N13"""
    return strip(F.coalesce(_c(x), F.lit("")))


def value_interleaved(record: str, metadata: str, *keys: str) -> Column:
    """For each key the record's value, then the metadata's."""
    return F.coalesce(*(empty_to_null(f"{part}.{k}") for k in keys for part in (record, metadata)))


def value_staged(record: str, metadata: str, *keys: str) -> Column:
    """All keys on the record, then all on the metadata."""
    return F.coalesce(*(empty_to_null(f"{part}.{k}") for part in (record, metadata) for k in keys))


def shorten(x, limit: int) -> Column:
    """N16"""
    return F.when(F.char_length(_c(x)) <= limit, _c(x)).otherwise(F.concat(F.rtrim(F.left(_c(x), F.lit(limit))), F.lit("...")))


def json_pointer(path) -> Column:
    """An array of keys as a pointer; ~ and / are escaped."""
    esc = F.transform(_c(path), lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    return F.concat(F.lit(""), F.array_join(F.transform(esc, lambda k: F.concat(F.lit("/"), k)), ""))


def training_header(title, section, heading, body, near: int = 300) -> Column:
    """Title, section, and the heading unless it already stands near the body's start; a blank line; the body."""
    told = F.instr(F.lower(F.left(_c(body), F.lit(near))), F.lower(F.coalesce(_c(heading), F.lit("")))) > 0
    head = F.concat_ws("\n", empty_to_null(title), empty_to_null(section), F.when(~told, empty_to_null(heading)))
    return F.when(head == "", _c(body)).otherwise(F.concat(head, F.lit("\n\n"), _c(body)))


def retrieval_header(source_type, title, section, heading, page=None, date=None, citation=None) -> Column:
    """Labelled lines by kind of source."""

    def line(label: str, value) -> Column:
        return F.concat(F.lit(label + ": "), empty_to_null(value)) if value is not None else F.lit(None).cast("string")

    kind = _c(source_type)
    act = F.concat_ws("\n", line("Act", title), line("Section", section), line("Heading", heading))
    page_ = F.concat_ws("\n", line("Constitution", title), line("PDF page", page))
    case = F.concat_ws("\n", line("Case", title), line("Date", date), line("Citation", shorten(citation, 500) if citation is not None else None))
    return F.when(kind == "central_act", act).when(kind == "constitution", page_).when(kind == "supreme_court", case).otherwise(line("Title", title))


def hashed_id(prefix: str, *parts) -> Column:
    """A prefix and twenty digits of SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *map(_c, parts)), 256), F.lit(20)))


def numbered_id(prefix: str, number, width: int) -> Column:
    """N20; a number of more digits keeps them all."""
    digits = _c(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def source_label(source_type, title, section=None, page=None) -> Column:
    """A citation label by kind of source, with defaults."""
    named = F.coalesce(empty_to_null(title), F.lit("Unknown source"))
    sect = empty_to_null(section) if section is not None else F.lit(None).cast("string")
    kind = _c(source_type)
    return (
        F.when(kind == "central_act", F.concat_ws(", ", named, sect))
        .when(kind == "constitution", F.concat_ws(", ", F.lit("Constitution"), F.concat(F.lit("page "), _c(page).cast("string")) if page is not None else F.lit(None).cast("string")))
        .when(kind == "supreme_court", named)
        .otherwise(named)
    )


def infer_source_type(explicit, text) -> Column:
    """N22"""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    by_text = F.when(t.contains("supreme court"), "supreme_court").when(t.contains("constitution of"), "constitution").otherwise("unknown")
    return F.coalesce(empty_to_null(explicit), by_text)


def document_key(title, section, row, *ids) -> Column:
    """The first id present, else title|section, else the row's number."""
    both = F.when(empty_to_null(title).isNotNull(), F.concat_ws("|", empty_to_null(title), empty_to_null(section)))
    return F.coalesce(*(empty_to_null(i) for i in ids), both, F.concat(F.lit("row-"), _c(row).cast("string")))


def case_key(x) -> Column:
    """Number-year after an optional prefix and before ___; else null."""
    return F.nullif(F.regexp_extract(_c(x), r"^(?:sc_)?(\d{1,8}-\d{4})(?:___.*)?$", 1), F.lit(""))


def language_class(name) -> tuple[Column, Column]:
    """(class, language) from the tags of a file name."""
    up = F.upper(F.coalesce(_c(name), F.lit("")))
    language = F.lit(None).cast("string")
    for tag, label in reversed(LANGUAGE_TAGS.items()):
        language = F.when(up.rlike(f"[_-]{tag}([_.-]|$)"), F.lit(label)).otherwise(language)
    marked = up.contains("VERNACULAR") | language.isNotNull()
    kind = F.when(marked, "vernacular_tagged").otherwise("english_or_untagged")
    return kind, F.when(marked, F.coalesce(language, F.lit("Unknown"))).otherwise("English/Untagged")


def parse_date(x) -> Column:
    """Ordinals go, then nine layouts are tried."""
    t = collapse(sub(x, r"(?i)(\d{1,2})(st|nd|rd|th)\b", "$1"))
    shapes = (
        r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{1,2} [A-Za-z]{4,} \d{4}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$",
        r"^\d{1,2}-[A-Za-z]{4,}-\d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    )
    # the shape keeps the strict parser from meeting a text that it would refuse with an error
    spelled = F.initcap(F.lower(t))
    return F.coalesce(*(F.when(t.rlike(s), F.try_to_date(spelled, f)) for s, f in zip(shapes, DATE_FORMATS, strict=True)))


def parse_duration(x) -> Column:
    """Seconds from 2m59.56s, 250ms, 7.66s or a plain number."""
    t = F.lower(F.trim(_c(x)))

    def part(unit: str, scale: float) -> Column:
        return F.coalesce(F.regexp_extract(t, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double") * scale, F.lit(0.0))

    fits = t.rlike(r"^(\d+(\.\d+)?h)?(\d+(\.\d+)?m)?(\d+(\.\d+)?s)?(\d+(\.\d+)?ms)?$") & (t != "")
    units = part("h", 3600.0) + part("m(?!s)", 60.0) + part("s", 1.0) + part("ms", 0.001)
    return F.coalesce(t.try_cast("double"), F.when(fits, units))


def plain_citations(x) -> Column:
    """Typographic brackets and line ranges around source numbers go."""
    return sub(x, r"[【\[]\s*S(\d+)(?:†[^】\]]*)?\s*[】\]]", "[S$1]")


def act_of_hint(x) -> Column:
    """A hint up to the first word for a section, article, order or rule, without marks at its end."""
    return strip(sub(sub(collapse(x), rf"(?i)\b(?:{'|'.join(PROVISION_WORDS)})s?\b.*$", ""), r"[ :;,–—-]+$", ""))


def sections_of_hint(x) -> Column:
    """The keys of all numbers behind the first word for a section, distinct, in order."""
    tail = F.regexp_extract(collapse(x), rf"(?i)\b(?:{'|'.join(SECTION_WORDS)})s?\b(.*)", 1)
    numbers = F.regexp_extract_all(tail, F.lit(r"\b(\d+[A-Za-z]{0,3})\b"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: section_key(F.concat(F.lit("Section "), n))))


def names_provision(x) -> Column:
    """N31"""
    return _c(x).rlike(r"(?i)\b(section|sec\.?|article|art\.?|order|rule)\s+(\d+|[ivxlc]+\b)")


def retrieval_terms(x) -> Column:
    """Distinct tokens of three letters and more, without stop words."""
    words = F.filter(F.split(match_text(x), " "), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*(F.lit(w) for w in RETRIEVAL_STOP)))


def words(x) -> Column:
    """Pieces between white space of any kind."""
    return F.array_remove(F.split(F.coalesce(_c(x), F.lit("")), r"(?U)\s+"), "")


def n_tokens(x) -> Column:
    """Words and single marks, a stand-in for a subword count."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"((?U)\w+|[^\w\s])"), F.lit(1)))


def safe_labels(x) -> Column:
    """An array without blanks."""
    return F.filter(F.transform(_c(x), lambda v: strip(v)), lambda v: v != "")


def pruned_json(**fields) -> Column:
    """An object of the fields that are not null."""
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in fields.items())))


def _without_role(line: Column) -> Column:
    """A line without the role label that ends it, and without the dots or dashes before the label; a label alone stays."""
    plain = F.regexp_replace(F.upper(line), r"(?:\s*\(\s*S\s*\)|S)$", "")
    word = F.regexp_extract(plain, "[A-Z]+$", 0)
    head = F.substring(line, F.lit(1), F.length(plain) - F.length(word))
    parted = F.right(head, F.lit(1)).isin(" ", "\t", *".…–—-")
    return F.when(word.isin(*ROLES) & parted, strip(sub(head, r"\s*[.…–—-]*\s*$", ""))).otherwise(line)


def clean_party(x) -> Column:
    """Lines that are empty, numbers, rules of dots or dashes, or notes of origin go, and so do role labels at a line's end."""
    lines = F.transform(F.split(_c(x), "\n"), lambda v: strip(v))
    only = lambda v, marks: F.translate(v, marks, "") == ""
    note = lambda v: F.ltrim(F.regexp_replace(F.upper(collapse(v)), r"^\(", "")).startswith(ORIGIN_NOTE)
    kept = F.filter(lines, lambda v: ~only(v, "0123456789") & ~only(v, ".…–— \t-") & ~note(v))
    return F.array_join(F.filter(F.transform(kept, _without_role), lambda v: v != ""), "\n")


def distinct_ignoring_case(x) -> Column:
    """The first spelling of every label, compared by upper case and single blanks, in order."""
    rows = F.transform(F.filter(F.transform(_c(x), lambda v: strip(v)), lambda v: v != ""), lambda v: F.struct(F.upper(collapse(v)).alias("k"), v.alias("v")))
    keys = F.transform(rows, lambda r: r["k"])
    first = F.filter(rows, lambda r, i: F.array_position(keys, r["k"]) == i + 1)
    return F.transform(first, lambda r: r["v"])


def case_title(petitioner, respondent, fallback) -> Column:
    """N39"""
    a = empty_to_null(sub(petitioner, r"(?i)\s+\b(versus|vs|v)\.?\s*$", ""))
    b = empty_to_null(respondent)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" v. "), b)).otherwise(F.coalesce(a, _c(fallback)))


def between(x, start: str, end: str) -> Column:
    """The text between two patterns, across lines; null where there is none."""
    return F.nullif(strip(F.regexp_extract(_c(x), rf"(?is){start}\s*(.*?)\s*{end}", 1)), F.lit(""))


def describe_json(x) -> Column:
    """Kind, keys and length of a JSON text."""
    kind = F.expr(f"schema_of_variant(try_parse_json({x}))")
    return F.to_json(F.struct(kind.alias("type"), F.json_object_keys(x).alias("keys"), F.json_array_length(x).alias("items"), F.length(x).alias("length")))
