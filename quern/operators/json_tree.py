"""JSON trees as tables of nodes, expanded level by level inside the engine.

Each level explodes the objects and arrays of the level above, so a document's nodes are rows as soon as they are
known: a document with millions of nodes is as many rows, and no task walks a tree. The number of jobs is the
depth of the deepest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.repair import parsed
from quern.sources.scratch import Scratch

#: Levels below the root; deeper documents raise.
MAX_DEPTH = 200


def _kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def tree_nodes(docs: DataFrame, key: str, json_col: str, scratch: Scratch | None = None) -> DataFrame:
    """(key, pointer, path, kind, parent_kind, value) of every node of every document.

    `path` holds the keys and array positions from the root, `pointer` the same as a JSON pointer, `value` the node as JSON. A text that
    is no JSON, or has a key twice in one object, gives one node of kind `bad_json`; a null gives none. Rows of one key are
    documents that share their pointers.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tree")
    spark = docs.sparkSession
    text = F.col(json_col)
    level = docs.where(text.isNotNull()).select(F.col(key).alias("k"), parsed(text).alias("v"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("parent_kind"))
    level = scratch.cut(level.select("*", F.when(F.col("v").isNull(), "bad_json").otherwise(_kind(F.col("v"))).alias("kind")), "level")
    every = level
    for _ in range(MAX_DEPTH):
        inner = level.where(F.col("kind").isin("object", "array"))
        child = inner.withColumnRenamed("k", "doc").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        at = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        below = child.select(F.col("doc").alias("k"), F.col("value").alias("v"), F.concat("path", F.array(at)).alias("path"), F.col("kind").alias("parent_kind"))
        level = scratch.cut(below.select("*", _kind(F.col("v")).alias("kind")), "level")
        if level.isEmpty():
            break
        every = every.union(level)
    else:
        raise ValueError(f"a document is deeper than {MAX_DEPTH} levels")
    return every.select(F.col("k").alias(key), T.json_pointer(F.col("path")).alias("pointer"), "path", "kind", "parent_kind", F.when(F.col("v").isNotNull(), F.to_json("v")).alias("value"))


def _last(path: str = "path", back: int = 1) -> Column:
    return F.when(F.size(path) >= back, F.element_at(path, F.when(F.size(path) >= back, F.lit(-back))))


def _has_key(name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys("value"), name), F.lit(False))


def is_section() -> Column:
    """an object below an object named sections, with a heading or paragraphs."""
    return (F.lower(_last(back=2)) == "sections") & (F.col("parent_kind") == "object") & (F.col("kind") == "object") & (_has_key("heading") | _has_key("paragraphs"))


def hierarchy_totals(nodes: DataFrame, key: str) -> DataFrame:
    """Per document the sections at the top and at any depth, the nested ones, containers of sections by kind, and whether it is broken or without sections."""
    container = F.coalesce(F.lower(_last()) == "sections", F.lit(False))
    section = F.coalesce(is_section(), F.lit(False))
    top = (F.size("path") == 2) & (F.get("path", F.lit(0)) == "Sections") & (F.col("parent_kind") == "object")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    out = nodes.groupBy(key).agg(
        count(top, "top_level_sections"),
        count(section, "sections"),
        count(section & (F.size("path") > 2), "nested_sections"),
        count(container & (F.col("kind") == "object"), "object_containers"),
        count(container & (F.col("kind") != "object"), "unknown_containers"),
        count(F.col("kind") == "bad_json", "bad"),
    )
    return out.select(key, "top_level_sections", "sections", "nested_sections", "object_containers", "unknown_containers", (F.col("bad") > 0).alias("bad_json"), (F.col("sections") == 0).alias("without_sections"))


def source_checks(records: DataFrame, nodes: DataFrame, key: str, pointer: str, text: str) -> DataFrame:
    """(key, pointer, resolves, texts, texts_kept): whether a record's pointer names a node, and how many of the node's texts the record holds.

    The node's texts are the strings at or below its `heading` and `paragraphs`. A null pointer resolves nowhere. Records are joined to nodes and
    to strings by (key, pointer); repeated records are counted together.
    """
    strings = nodes.where("kind = 'string'").select(F.col(key).alias("k"), "path", F.trim(F.try_variant_get(F.try_parse_json("value"), "$", "string")).alias("piece")).where("piece <> ''")
    # a string belongs to every node above it from which a heading or paragraphs lead to it
    owner = strings.select("k", "piece", F.posexplode("path").alias("at", "name"), "path").where("name in ('heading', 'paragraphs')")
    owned = owner.select("k", "piece", T.json_pointer(F.slice("path", F.lit(1), F.col("at"))).alias("p"))
    asked = records.select(F.col(key).alias("rk"), F.col(pointer).alias("rp"), F.col(text).alias("rt"))
    found = nodes.where("kind <> 'bad_json'").select(F.col(key).alias("nk"), F.col("pointer").alias("np")).distinct()
    there = asked.join(found, (F.col("rk") == F.col("nk")) & (F.col("rp") == F.col("np")), "left")
    met = there.join(owned, (F.col("rk") == F.col("k")) & (F.col("rp") == F.col("p")), "left")
    kept = F.count_if(F.coalesce(F.contains("rt", "piece"), F.lit(False)))
    return met.groupBy(F.col("rk").alias(key), F.col("rp").alias(pointer)).agg(F.max(F.col("nk").isNotNull()).alias("resolves"), F.count("piece").alias("texts"), kept.alias("texts_kept"))
