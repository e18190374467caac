"""Queries on JSON trees. The acts are built from columns of documents by one SQL text that both engines run: nested chapters, sections in lists, empty and broken acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import json_tree as J
from quern.plans.registry import query

ACTS_COLUMN = """CASE WHEN doc_id % 11 = 0 THEN '{"Act Title":"' || source || '","Sections":{' WHEN doc_id % 11 = 1 THEN '{"Act Title":"' || source || '","Sections":[{"heading":"' || lang || '"},7,null,true]}'
    WHEN doc_id % 11 = 2 THEN '{"Act Title":"' || source || '","Sections":{},"Size":' || n_chars || '.5}' WHEN doc_id % 11 = 3 THEN '["' || (source || lang) || '",[[],{"sections":"none"}]]'
    ELSE '{"Act Title":"' || source || '","Act ID":' || doc_id || ',"Sections":{"Section 1.":{"heading":"' || (source || lang) || '","paragraphs":["' || lang || '",{"0":"' || source || '","1":{"text":"a/b~c"}}]},"Section 2/a":{"heading":"","extra":{"SECTIONS":{"~x":{"paragraphs":{"0":"deep ' || n_chars || '"}},"y":{"note":"no section"}}}},"z":"' || lang || '"},
      "Chapters":{"0":{"Name":"Chapter I","Sections":{"Section 3":{"paragraphs":{}},"Section 4":{"heading":"h ' || n_chars || '"}}}}}' END AS act"""
ACTS = f"SELECT doc_id, {ACTS_COLUMN} FROM d"
COLUMNS = ("doc_id", "coalesce(source, 'none') AS source", "coalesce(lang, 'xx') AS lang", "coalesce(n_chars, 0) AS n_chars")
NODES = f"""WITH RECURSIVE d AS (SELECT {', '.join(COLUMNS)} FROM documents), acts AS ({ACTS}), nodes(k, pointer, depth, parent_kind, key, above, j) AS (
    SELECT doc_id, '', 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, act::JSON FROM acts WHERE json_valid(act)
    UNION ALL SELECT k, pointer || '/' || replace(replace(step, '~', '~0'), '/', '~1'), depth + 1, json_type(j), step, key, json_extract(j, '/' || replace(replace(step, '~', '~0'), '/', '~1'))
    FROM (SELECT *, unnest(CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda x: x::VARCHAR) ELSE [] END) AS step FROM nodes)),
  kinds AS MATERIALIZED (SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM nodes)"""


def _table(t):
    return t("documents").selectExpr(*COLUMNS)


def _nodes(t):
    return J.tree_nodes(_table(t).selectExpr("doc_id", ACTS_COLUMN), "doc_id", "act")


@query("tree_nodes", f"{NODES} SELECT k AS doc_id, pointer, kind, depth FROM kinds UNION ALL SELECT doc_id, '', 'bad_json', 0 FROM acts WHERE NOT json_valid(act)")
def tree_nodes(t):
    """X28"""
    return _nodes(t).select("doc_id", "pointer", "kind", F.size("path").alias("depth"))


SECTION = "lower(above) = 'sections' AND parent_kind = 'OBJECT' AND kind = 'object' AND (list_contains(json_keys(j), 'heading') OR list_contains(json_keys(j), 'paragraphs'))"


@query(
    "act_hierarchy",
    f"""{NODES} SELECT doc_id, count(*) FILTER (depth = 2 AND starts_with(pointer, '/Sections/') AND parent_kind = 'OBJECT') AS top_level_sections, count(*) FILTER ({SECTION}) AS sections, count(*) FILTER ({SECTION} AND depth > 2) AS nested_sections,
      count(*) FILTER (lower(key) = 'sections' AND kind = 'object') AS object_containers, count(*) FILTER (lower(key) = 'sections' AND kind <> 'object') AS unknown_containers, NOT json_valid(any_value(act)) AS bad_json, count(*) FILTER ({SECTION}) = 0 AS without_sections
    FROM acts LEFT JOIN kinds ON k = doc_id GROUP BY doc_id""",
)
def act_hierarchy(t):
    """A30, F10"""
    return J.hierarchy_totals(_nodes(t), "doc_id")


RECORD_FORMS = [
    ("'/Sections/Section 1.'", "(source || lang) || ' / ' || lang || ' / ' || source"),
    ("'/Sections/Section 2~1a/extra/SECTIONS/~0x'", "'deep ' || doc_id"),
    ("'/Chapters/0/Sections/Section 4'", "'h ' || n_chars || '.'"),
    ("CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/Sections/Section 9' END", "source"),
]
RECORDS = " UNION ALL ".join(f"SELECT doc_id, {pointer} AS pointer, {body} AS body FROM d" for pointer, body in RECORD_FORMS)


@query(
    "act_record_sources",
    f"""{NODES}, records AS ({RECORDS}), strings AS (SELECT k, pointer AS place, json_extract_string(j, '$') AS piece FROM kinds WHERE kind = 'string' AND trim(json_extract_string(j, '$')) <> ''),
      met AS (SELECT r.*, n.k IS NOT NULL AS there, s.piece FROM records r LEFT JOIN kinds n ON n.k = r.doc_id AND n.pointer = r.pointer
        LEFT JOIN strings s ON s.k = r.doc_id AND (s.place = r.pointer || '/heading' OR s.place = r.pointer || '/paragraphs' OR starts_with(s.place, r.pointer || '/paragraphs/') OR starts_with(s.place, r.pointer || '/heading/')))
    SELECT doc_id, pointer, bool_or(there) AS resolves, count(piece) AS texts, count(*) FILTER (contains(body, piece)) AS texts_kept FROM met GROUP BY doc_id, pointer""",
)
def act_record_sources(t):
    """J10, N17"""
    records = _table(t).selectExpr("doc_id", f"inline(array({', '.join(f'struct({p} AS pointer, {b} AS body)' for p, b in RECORD_FORMS)}))")
    return J.source_checks(records, _nodes(t), "doc_id", "pointer", "body")
