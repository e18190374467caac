"""Page layout: the lines of documents set on pages in two columns, with headings, page numbers and separators at known places."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import parse as P
from quern.plans.registry import query

#: (condition, text, x0, y0) of the lines put on a page beside its body; two separators on some pages, one too high to count.
EXTRA = [
    ("doc_id % 2 = 0", "'(' || (doc_id % 900) || ')'", "290.0", "820.0"),
    ("doc_id % 4 = 1", "' ' || (doc_id % 50)", "30.0", "20.0"),
    ("doc_id % 3 <> 2", "'THE LAW REPORTS, ' || upper(lang)", "200.0", "40.5"),
    ("doc_id % 3 = 0", "'____________________'", "60.0", "500.25"),
    ("doc_id % 9 = 0", "' ____________ '", "60.0", "640.0"),
    ("doc_id % 5 = 0", "'_____________'", "60.0", "200.0"),
    ("doc_id % 7 = 0", "'12'", "290.0", "400.0"),
]
BODY_Y, BODY_X = "110 + (i * 37) % 700 + (i % 3) * 0.01", "60 + ((i + 1) % 2) * 240"
LINES = "SELECT doc_id, line AS text, ({x})::DOUBLE AS x0, ({y})::DOUBLE AS y0 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))::BIGINT)) AS i FROM documents)".format(x=BODY_X, y=BODY_Y)
ALL_LINES = LINES + "".join(f" UNION ALL SELECT doc_id, {text}, {x}, {y} FROM documents WHERE {when}" for when, text, x, y in EXTRA)
_JOIN = "coalesce(string_agg(text, chr(10) ORDER BY round(y0, 1), x0, text) FILTER (part = '{}'), '')"


@query(
    "page_layout",
    f"""WITH lines AS MATERIALIZED ({ALL_LINES}), marked AS (SELECT *, regexp_matches(trim(text), '^_{{12,}}$') AS rule, regexp_matches(trim(text), '^\\(?\\d{{1,4}}\\)?$') AND ((y0 < 0.12 * 842 AND x0 < 0.25 * 595) OR (y0 > 0.88 * 842 AND x0 BETWEEN 0.35 * 595 AND 0.65 * 595)) AS num,
        y0 < 0.12 * 842 AND regexp_matches(trim(text), '^[A-Z][A-Z ()''.,-]{{5,}}$') AS head FROM lines),
      cuts AS (SELECT doc_id, min(y0) FILTER (rule AND y0 > 0.38 * 842) AS separator_y, count(*) FILTER (rule AND y0 > 0.38 * 842) AS separators FROM marked GROUP BY doc_id),
      parts AS (SELECT m.*, separator_y, separators, CASE WHEN num THEN 'page_number' WHEN head THEN 'header' WHEN rule THEN 'rule' WHEN y0 > separator_y THEN 'footnote' ELSE 'main' END AS part FROM marked m JOIN cuts USING (doc_id)),
      pages AS (SELECT doc_id, any_value(separator_y) AS separator_y, any_value(separators) AS separators, {_JOIN.format('header')} AS header_text, {_JOIN.format('page_number')} AS page_number_text, {_JOIN.format('main')} AS main_text, {_JOIN.format('footnote')} AS footnotes_text FROM parts GROUP BY doc_id)
    SELECT doc_id, separator_y, header_text, page_number_text, md5(main_text) AS main_md5, md5(footnotes_text) AS footnotes_md5, array_to_string(list_filter([CASE WHEN separator_y IS NULL THEN 'no_separator' END, CASE WHEN separators > 1 THEN 'several_separators' END,
      CASE WHEN page_number_text = '' THEN 'no_page_number' END, CASE WHEN main_text = '' THEN 'empty_main_text' END], lambda x: x IS NOT NULL), ',') AS flags FROM pages""",
)
def page_layout(t):
    """Boxed lines in reading order, zones from separators, page numbers and headings by place."""
    docs = t("documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    body = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).selectExpr("doc_id", "text", f"cast({BODY_X} as double) AS x0", f"cast({BODY_Y} as double) AS y0")
    more = docs.selectExpr("doc_id", "inline(filter(array(" + ", ".join(f"struct({text} AS text, cast({x} as double) AS x0, cast({y} as double) AS y0, {when} AS there)" for when, text, x, y in EXTRA) + "), e -> e.there))").drop("there")
    found = P.split_page_lines(body.union(more), "doc_id")
    return found.select("doc_id", "separator_y", "header_text", "page_number_text", F.md5("main_text").alias("main_md5"), F.md5("footnotes_text").alias("footnotes_md5"), F.array_join("quality_flags", ",").alias("flags"))
