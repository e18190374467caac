"""Queries of chunking, spans, pages and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunk as K
from quern.operators import judgments as J
from quern.operators import parse as P
from quern.plans.registry import query
from quern.plans.text_queries import judgment_sql, words_sql


def chunks_sql(window: int, overlap: int, base: int, least: int = 1) -> str:
    step = window - overlap
    return f"""SELECT doc_id, i + {base} AS chunk_index, n AS chunk_count, i * {step} AS word_start, least(len(w), i * {step} + {window})::BIGINT AS word_end,
      (least(len(w), i * {step} + {window}) - i * {step})::BIGINT AS word_count, array_to_string(w[i * {step} + 1:i * {step} + {window}], ' ') AS text
      FROM (SELECT doc_id, w, n, unnest(range(n)) AS i FROM (SELECT doc_id, w, CASE WHEN len(w) <= {window} THEN 1 ELSE 1 + ceil((len(w) - {window}) / {step})::BIGINT END::BIGINT AS n
      FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents) WHERE len(w) >= {least}))"""


def digest_sql(inner: str) -> str:
    return f"SELECT doc_id, chunk_index, chunk_count, word_start, word_end, word_count, md5(text) AS text_md5 FROM ({inner})"


def _digest(chunks):
    return chunks.withColumn("text_md5", F.md5("text")).drop("text")


@query("chunks_v2", digest_sql(chunks_sql(*K.RETRIEVAL, least=20)))
def chunks_v2(t):
    """X01, F04"""
    return _digest(K.chunk(t("documents"), "doc_id", "text", K.RETRIEVAL, 20))


@query("chunks_v1", digest_sql(chunks_sql(*K.RETRIEVAL_V1)))
def chunks_v1(t):
    """X02"""
    return _digest(K.chunk(t("documents"), "doc_id", "text", K.RETRIEVAL_V1))


@query("chunks_scenario", digest_sql(chunks_sql(*K.SCENARIO)))
def chunks_scenario(t):
    """X03"""
    return _digest(K.chunk(t("documents"), "doc_id", "text", K.SCENARIO))


COUNTS = f"SELECT doc_id, CASE WHEN n <= 320 THEN 1 ELSE 1 + ceil((n - 320) / 270)::BIGINT END::BIGINT AS n_chunks FROM (SELECT doc_id, len({words_sql('text')}) AS n FROM documents)"


def _counts(t):
    return t("documents").select("doc_id", K.chunk_count(F.size(T.words("text")), *K.RETRIEVAL[:2]).alias("n_chunks"))


@query(
    "chunk_histogram",
    f"SELECT CASE WHEN n_chunks = 1 THEN '1' WHEN n_chunks <= 5 THEN '2-5' WHEN n_chunks <= 20 THEN '6-20' WHEN n_chunks <= 100 THEN '21-100' ELSE '101+' END AS bucket, count(*) AS documents, sum(n_chunks)::BIGINT AS chunks FROM ({COUNTS}) GROUP BY 1",
)
def chunk_histogram(t):
    """A07"""
    return K.chunk_histogram(_counts(t), "n_chunks")


@query("chunk_argmax", f"SELECT max(n_chunks) AS most, (SELECT doc_id FROM ({COUNTS}) ORDER BY n_chunks DESC, doc_id LIMIT 1) AS doc_id FROM ({COUNTS})")
def chunk_argmax(t):
    """A08"""
    best = _counts(t).agg(F.max(F.struct("n_chunks", (-F.col("doc_id")).alias("m"))).alias("b"))
    return best.select(F.col("b.n_chunks").alias("most"), (-F.col("b.m")).alias("doc_id"))


STARTS = "SELECT doc_id, unnest(range(len(l))) AS k, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
LINES = f"SELECT doc_id, k, (CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(l[1:k], lambda x: length(x) + 1)) END)::BIGINT AS start, length(l[k + 1]) AS n FROM ({STARTS})"


def _lines(t):
    split = F.split("text", "\n")
    lines = t("documents").select("doc_id", F.length("text").cast("long").alias("whole"), F.posexplode(split).alias("k", "line"))
    from pyspark.sql import Window

    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc_id", "whole", F.col("k").cast("long").alias("k"), F.coalesce(before, F.lit(0)).cast("long").alias("start"))


@query("span_lead", f'SELECT doc_id, k, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) AS "end" FROM ({LINES}) JOIN documents USING (doc_id)')
def span_lead(t):
    """Line spans, the last to the end of the text."""
    return K.spans(_lines(t), "doc_id", "start", "whole").select("doc_id", "k", "start", "end")


@query(
    "span_overlap",
    f"""WITH s AS (SELECT doc_id, k, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) AS stop FROM ({LINES}) JOIN documents USING (doc_id)),
      p AS (SELECT doc_id, unnest(range(ceil(greatest(length(text), 1) / 1000)::BIGINT)) AS page FROM documents)
      SELECT s.doc_id, s.k, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM s JOIN p ON s.doc_id = p.doc_id AND s.start < (page + 1) * 1000 AND s.stop > page * 1000 GROUP BY ALL""",
)
def span_overlap(t):
    """Which thousand-character pages a line lies on."""
    spans = K.spans(_lines(t), "doc_id", "start", "whole").select("doc_id", "k", "start", "end")
    n = F.ceil(F.greatest(F.length("text"), F.lit(1)) / 1000).cast("long")
    pages = t("documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("page"))
    pages = pages.select("doc_id", "page", (F.col("page") * 1000).alias("start"), ((F.col("page") + 1) * 1000).alias("end"))
    met = K.overlapping(spans, pages, "doc_id")
    return met.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.k").alias("k")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_pages"))


@query(
    "boundary_candidates",
    """SELECT item_id, position, substr(text, greatest(position - 80, 1), position - greatest(position - 80, 1)) AS before, substr(text, position, 450) AS after
      FROM (SELECT item_id, text, strpos(text, '.') AS position FROM benchmark) WHERE position > 0""",
)
def boundary_candidates(t):
    """X31"""
    return P.boundary_candidates(t("benchmark"), "item_id", "text", r"\.")


@query(
    "page_split",
    """SELECT page_id, y > 0 AS has_separator, CASE WHEN y > 0 THEN left(html, y - 1) ELSE html END AS main_text, CASE WHEN y > 0 THEN substr(html, y) ELSE '' END AS footnotes
      FROM (SELECT page_id, html, CASE WHEN strpos(html, '<footer') > length(html) * 0.38 THEN strpos(html, '<footer') ELSE 0 END AS y FROM pages)""",
)
def page_split(t):
    """Main text and what follows a separator in a page's lower part."""
    return P.split_at_separator(t("pages"), "page_id", "html", "<footer", 0.38)


@query(
    "ext_histogram",
    "SELECT CASE WHEN regexp_matches(p, '\\.[a-z]+$') THEN regexp_extract(p, '\\.([a-z]+)$', 1) ELSE 'none' END AS extension, count(*) AS n FROM (SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages) GROUP BY 1",
)
def ext_histogram(t):
    """S18"""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return t("pages").select(F.coalesce(F.nullif(F.regexp_extract(path, r"\.([a-z]+)$", 1), F.lit("")), F.lit("none")).alias("extension")).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


BODY = judgment_sql("body")
HEADERS = f"""WITH built AS (SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 2 AS legacy, source, lang, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'X. Y. Roe, J.' || chr(10) || text END AS body FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
  read AS (SELECT *, {BODY} AS judgment_text, CASE WHEN legacy THEN make_date(1995, 2, 10 + (doc_id % 9)::INTEGER) WHEN doc_id % 4 = 1 THEN DATE '2015-03-03' END AS judgment_date, CASE WHEN legacy THEN 'A. JUDGE; B. JUDGE' ELSE 'HON. A; HON. B' END AS bench FROM built),
  flagged AS (SELECT *, concat_ws(',', CASE WHEN judgment_text = '' THEN 'missing_judgment_body' END, CASE WHEN judgment_date IS NULL THEN 'missing_or_invalid_date' END, CASE WHEN length(judgment_text) BETWEEN 1 AND 299 THEN 'short_judgment_body' END) AS quality_flags FROM read)
  SELECT doc_id, CASE WHEN legacy THEN 'legacy' ELSE 'modern' END AS document_format, source AS petitioner, 'State ' || lang AS respondent, judgment_date, bench, CASE WHEN NOT legacy THEN 'CURATIVE PETITION NOS. ' || doc_id || ' OF 2015' END AS case_number,
    CASE WHEN NOT legacy THEN 'X. Y. Roe, J.' END AS judgment_author, length(judgment_text) AS body_characters, md5(judgment_text) AS body_md5, source || ' v. State ' || lang AS title, quality_flags,
    CASE WHEN quality_flags = '' THEN 'parsed' ELSE 'review_required' END AS parse_status, CASE WHEN length(judgment_text) >= 300 THEN 'usable' ELSE 'review_required' END AS text_status FROM flagged"""


def _written_judgments(t):
    nl = F.lit("\n")
    label = F.concat(
        F.lit("IN THE COURT\nPETITIONER:\n"), "source", F.lit("\n\tVs.\nRESPONDENT:\nState "), "lang", F.lit("\n\nDATE OF JUDGMENT 1"), F.col("doc_id") % 9, F.lit("/02/1995\n\nBENCH:\nA. JUDGE\nB. JUDGE\nBENCH: a. judge\nACT:\n\nJUDGMENT:\n"), "text"
    )
    separator = F.when(F.col("doc_id") % 4 == 1, F.lit("Versus")).otherwise(F.lit(" V "))
    heading = F.when(F.col("doc_id") % 4 == 1, F.lit("J U D G M E N T :")).otherwise(F.lit("ORDER."))
    dated = F.when(F.col("doc_id") % 4 == 1, F.lit("Pronounced on: 3rd March, 2015")).otherwise(F.lit("3rd March 2015"))
    modern = F.concat(
        F.lit("REPORTABLE\nCIVIL APPEAL NO. 1 OF 1999\nCurative Petition Nos. "), F.col("doc_id"), F.lit(" of 2015\n(Arising out of an order)\n"), "source", F.lit(" ... Appellant(s)\n"), separator, F.lit("\n1\nState "), "lang",
        F.lit("\n... Respondent(s)\nCoram: Hon. A\nHon. B\nCounsel: none\n"), dated, nl, heading, F.lit("\nX. Y. Roe, J.\n"), "text",
    )
    return t("documents").where("source is not null and lang is not null and text is not null").select("doc_id", F.when(F.col("doc_id") % 2 == 0, label).otherwise(modern).alias("raw"))


@query("judgment_headers", HEADERS)
def judgment_headers(t):
    """Judgments written around the documents' texts, parsed by layout; the SQL says what was written into them."""
    found = J.parse_judgments(_written_judgments(t), "doc_id", "raw")
    return found.withColumns({"body_md5": F.md5("judgment_text"), "case_number": F.upper("case_number"), "bench": F.upper("bench")}).drop("judgment_text")


LEGACY_HEADER = "'IN THE COURT' || chr(10) || 'PETITIONER:' || chr(10) || source || chr(10) || chr(9) || 'Vs.' || chr(10) || 'RESPONDENT:' || chr(10) || 'State ' || lang || chr(10) || chr(10) || 'DATE OF JUDGMENT 1' || (doc_id % 9) || '/02/1995' || chr(10) || chr(10) || 'BENCH:' || chr(10) || 'A. JUDGE' || chr(10) || 'B. JUDGE' || chr(10) || 'BENCH: a. judge' || chr(10) || 'ACT:' || chr(10)"


@query(
    "judgment_review",
    f"""SELECT h.doc_id, document_format, CASE WHEN document_format = 'legacy' THEN md5({LEGACY_HEADER}) END AS legacy_header_md5, false AS headnote_in_source, title, judgment_date, left(r.judgment_text, 1200) AS body_start, right(r.judgment_text, 600) AS body_end,
      concat_ws(',', CASE WHEN judgment_date IS NULL THEN 'judgment_date' END, CASE WHEN body_characters = 0 THEN 'judgment_text' END) AS missing
    FROM ({HEADERS}) h JOIN (SELECT doc_id, source, lang, {BODY} AS judgment_text FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'X. Y. Roe, J.' || chr(10) || text END AS body FROM documents)) r USING (doc_id)""",
)
def judgment_review(t):
    """L21"""
    found = J.review_report(_written_judgments(t), "doc_id", "raw")
    legacy = F.when(F.col("document_format") == "legacy", F.md5("raw_header"))
    return found.select("doc_id", "document_format", legacy.alias("legacy_header_md5"), "headnote_in_source", "title", "judgment_date", "body_start", "body_end", "missing")


@query("act_sections", None)
def act_sections(t):
    """Sections of nested acts built from parts, found at any depth."""
    act = F.to_json(
        F.struct(
            F.col("p_name").alias("Act Title"),
            F.struct(F.struct(F.col("p_type").alias("heading"), F.array("p_brand", F.lit("text")).alias("paragraphs")).alias("Section 1.")).alias("Sections"),
            F.struct(F.struct(F.lit("Chapter I").alias("Name"), F.struct(F.struct(F.lit("Deep").alias("heading"), F.struct(F.col("p_type").alias("0"), F.col("p_brand").alias("1")).alias("paragraphs")).alias("Section 2/a")).alias("Sections")).alias("0")).alias("Chapters"),
        )
    )
    return P.act_sections(t("part").select("p_partkey", act.alias("j")), "p_partkey", "j")
