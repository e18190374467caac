"""Salvage of JSON from answers in prose, inside the engine; only what it cannot settle reaches Python.

Strings, braces and brackets are cut out of a text by one pattern, and one fold over them, a small state machine, finds
where objects balance. What a fold finds counts if it parses. A text whose first object does not balance or parse (broken
quotes, keys named twice, an object that is cut off around a whole one) is handed to the decoder in Python; others pass it as null.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import repair as R

_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\]]'
_SPAN = "struct<start:bigint,end:bigint>"


def _tokens(text: Column) -> Column:
    """(skip, quote, token) of the strings, braces and brackets of a text, and whether a lone quote stands before one."""
    pieces, found = F.split(text, rf"(?s){_TOKEN}", -1), F.regexp_extract_all(text, F.lit(rf"(?s){_TOKEN}"), F.lit(0))
    return F.zip_with(pieces, found, lambda p, t: F.struct(F.length(p).cast("long").alias("skip"), p.contains('"').alias("quote"), t.alias("token")))


def _objects(text: Column, most: int | None = None) -> Column:
    """(spans, closed, odd): the objects at the top of a text, until a bracket closes that was not opened, or `most` are found.

    `odd` says that the text holds something else at the top than objects, or marks that do not pair: it needs the decoder.
    """
    zero = F.lit(0)
    start = {"at": zero.cast("long"), "braces": zero, "brackets": zero, "begin": zero.cast("long"), "closed": F.lit(False), "odd": F.lit(False), "spans": F.expr(f"cast(array() as array<{_SPAN}>)")}

    def step(a: Column, t: Column) -> Column:
        token, place = t["token"], a["at"] + t["skip"]
        top, flat = a["braces"] == 0, a["brackets"] == 0
        enough = (F.size(a["spans"]) >= most) if most else F.lit(False)
        done = (token == "}") & (a["braces"] == 1)
        odd = t["quote"] | (top & ~token.isin("{", "]")) | ((token == "]") & flat & ~top) | (done & ~flat)
        moved = {
            "at": place + F.length(token),
            "braces": a["braces"] + F.when(token == "{", 1).when((token == "}") & ~top, -1).otherwise(0),
            "brackets": a["brackets"] + F.when(top, 0).when(token == "[", 1).when((token == "]") & ~flat, -1).otherwise(0),
            "begin": F.when(top & (token == "{"), place).otherwise(a["begin"]),
            "closed": top & (token == "]"),
            "odd": a["odd"] | odd,
            "spans": F.when(done, F.concat(a["spans"], F.array(F.struct(a["begin"].alias("start"), (place + 1).alias("end"))))).otherwise(a["spans"]),
        }
        return F.when(a["closed"] | token.isNull() | enough, a).otherwise(F.struct(*(v.alias(k) for k, v in moved.items())))

    # the last piece has no token: its row is passed over, but for a lone quote
    return F.aggregate(_tokens(text), F.struct(*(v.alias(k) for k, v in start.items())), step, lambda a: F.struct(a["spans"].alias("spans"), a["closed"].alias("closed"), a["odd"].alias("odd")))


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _first_slow(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(v, ensure_ascii=False) if (v := R.first_object(t)) is not None else None)

    return run(text)


def first_object(text: Column) -> Column:
    """The first JSON object that decodes, wherever it starts; null where there is none."""
    at = F.instr(text, F.lit("{"))
    rest = F.when(at > 0, F.substring(text, at, F.length(text)))
    span = F.get(_objects(rest, 1)["spans"], F.lit(0))
    fast = F.when(span.isNotNull() & (span["start"] == 0), _cut(rest, span))
    fast = F.when(_parses(fast), fast)
    return F.coalesce(fast, _first_slow(F.when(rest.isNotNull() & fast.isNull(), text)))


def _array_of(text: Column, key: str) -> Column:
    """The objects of a whole text's array; null where the text is no JSON, none where it has no such array."""
    tree = R.parsed(text)
    items = F.transform(F.try_variant_get(tree, f"$.{key}", "array<variant>"), lambda v: F.to_json(v))
    return F.when(tree.isNotNull(), F.coalesce(F.filter(items, lambda v: v.startswith("{")), F.array().cast("array<string>")))


def _items_slow(key: str):
    @F.pandas_udf("items array<string>, partial boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [R.array_items(t, key) if t is not None else ([], None) for t in texts]
        return pd.DataFrame({"items": [[json.dumps(i, ensure_ascii=False) for i in items] for items, _ in found], "partial": [p for _, p in found]})

    return run


def array_objects(df: DataFrame, text: str, key: str, out: str = "found") -> DataFrame:
    """Adds a struct of the named array's objects as JSON texts, and whether the array was cut off. Of a whole text, of its outermost object, else those that are complete."""
    plain = R.strip_fences(F.coalesce(F.col(text), F.lit("")))
    whole = F.coalesce(_array_of(plain, key), _array_of(R.outer_object(plain), key))
    begin = F.regexp_instr(plain, F.lit(rf'"{key}"\s*:\s*\['))
    head = F.length(F.regexp_extract(plain, rf'"{key}"\s*:\s*\[', 0))
    region = F.when(whole.isNull() & (begin > 0), F.substring(plain, begin + head, F.length(plain)))
    # a balanced object that the engine's parser rejects may be one to the decoder, as with a key named twice
    outer = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    span = F.get(_objects(outer, 1)["spans"], F.lit(0))
    doubt = F.coalesce((span["start"] == 0) & (span["end"] == F.length(outer)), F.lit(False))
    step = df.withColumns({"__whole": whole, "__region": region, "__none": whole.isNull() & (begin == 0) & ~plain.rlike(r"(?s)\{.*\}")}).withColumn("__spans", _objects(F.col("__region")))
    step = step.withColumn("__cut", F.transform(F.col("__spans")["spans"], lambda s: _cut(F.col("__region"), s)))
    fit = F.coalesce(F.forall("__cut", _parses) & ~F.col("__spans")["odd"] & ~doubt, F.lit(False))
    step = step.withColumn("__slow", _items_slow(key)(F.when(F.col("__whole").isNull() & ~F.col("__none") & ~fit, F.col(text))))
    empty = F.array().cast("array<string>")
    items = F.when(F.col("__whole").isNotNull(), F.col("__whole")).when(F.col("__none"), empty).when(fit, F.col("__cut")).otherwise(F.col("__slow.items"))
    partial = F.when(F.col("__whole").isNotNull(), F.lit(False)).when(F.col("__none"), F.lit(True)).when(fit, ~F.col("__spans")["closed"]).otherwise(F.col("__slow.partial"))
    return step.withColumn(out, F.struct(items.alias("items"), partial.alias("partial"))).select(*df.columns, out)


def _marked_slow(marker: str):
    @F.pandas_udf("array<struct<id:string,object:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"id": k, "object": json.dumps(v, ensure_ascii=False)} for k, v in R.by_marker(t, marker).items()] if t is not None else None)

    return run


def marked_objects(text: Column, marker: str = "source_id") -> Column:
    """(id, object) of the objects that open with the marker, in order; the first of an id stays, broken ones are left out."""
    opening = rf'\{{\s*"{marker}"\s*:\s*"[^"]+"'
    pieces = F.split(F.coalesce(text, F.lit("")), f"(?={opening})", -1)
    own = F.filter(pieces, lambda p: p.rlike(f"^{opening}"))
    made = F.transform(own, lambda p: F.struct(F.regexp_extract(p, rf'^\{{\s*"{marker}"\s*:\s*"([^"]+)"', 1).alias("id"), _cut(p, F.get(_objects(p, 1)["spans"], F.lit(0))).alias("object")))
    sound = F.forall(made, lambda m: m["object"].isNotNull() & _parses(m["object"]))
    ids = F.transform(made, lambda m: m["id"])
    first = F.filter(made, lambda m, i: F.array_position(ids, m["id"]) == i + 1)
    return F.when(sound, first).otherwise(_marked_slow(marker)(F.when(~sound, text)))
