"""Personal data: base patterns that always count, and boosted trees over wider candidates; built-in functions and Spark's ML library only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers by strict patterns. Candidates come from wider
patterns, one per kind, of high recall: spelled-out addresses ("name (at) mail dot com"), dots in brackets, cards
with unusual separators, phones without a plus. Candidates of different kinds may overlap. Boosted trees score each from its format
(digits, groups, separators, checksum) and its context (words before it, neighbouring characters); the score is
compiled into one SQL expression. A candidate is taken if its score reaches its kind's threshold, the lowest at which
held-out rows are right in PRECISION of the cases. Candidates that overlap a base span are
dropped; of a chain of overlapping candidates the highest score stays (then the longer, then the earlier kind).

The trees are fitted on all different base spans. Each is rewritten in
the ways in which people disguise or shorten such data (label 1) and into things that look alike (label 0: a wrong
checksum, dates, order numbers, lists of numbers, plain sentences), with and without a leading word. Three quarters
fit the trees, one quarter sets the thresholds. Rows of equal features count as one of their number's weight, so that the
trees read a table of the formats that occur, whose size the features' few values bound. A table with fewer than LEAST_SPANS base spans has no model, and base spans alone.

Texts are searched once. Matches are written with the lengths between them as a small table; running sums per document
give the positions, so a text with any number of matches is handled in linear time. All patterns start only where a run of
their first characters starts, or where the last match ended, so that long runs cost linear time as well.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans. Repeated rows, and rows of equal or null
ids, are judged each. An empty table gives an empty result. Extra columns are not read. Reruns agree: rewritings are chosen by hash,
and the trees are fitted on one sorted partition of weighted formats.
"""

from __future__ import annotations

from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Rewritten rows without which no trees are fitted.
LEAST_SPANS = 20
TREES, DEPTH, RATE = 12, 4, 0.3
PRECISION = 0.98
#: Code points of context before and after a match.
BEFORE, AFTER = 40, 8

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. \G lets a match start in the run in which the last one ended.
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_OPEN, _CLOSE = r"\x20?[(\[{<]\x20?", r"\x20?[)\]}>]\x20?"
_LABEL = "[A-Za-z0-9-]{1,63}"
_AT = rf"(?:{_OPEN}(?:at|AT|@){_CLOSE}|\x20?@\x20?)"
_DOT = rf"(?:{_OPEN}(?:dot|DOT|\.){_CLOSE}|\x20(?:dot|DOT)\x20|\.)"
#: The candidates' patterns.
WIDE = (
    rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}|\x20(?:at|AT)\x20){_LABEL}(?:{_DOT}{_LABEL}){{1,5}}",
    rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:(?:{_OPEN}(?:dot|\.){_CLOSE}|\x20dot\x20|[.,])[0-9]{{1,3}}){{3}}(?![0-9])",
    r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20./()-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])(?:\+|00)?[0-9]{7,15}(?![0-9A-Za-z])",
)
#: Words that a text must hold for a pattern to be tried.
_HINTS = ("(?i)@|[(\\[{< ]at[)\\]}> ]", "[0-9]", "[0-9]", "[0-9]")
_CUES = (
    ("mail", "e-mail: ", "contact ", "write to ", "correo "),
    ("ip ", "host ", "address ", "server ", "login from "),
    ("card ", "visa ", "credit card: ", "cc ", "paid with "),
    ("call ", "tel: ", "phone ", "mobile ", "fax "),
)
_OTHER_CUES = ("order ", "invoice ", "ref: ", "version ", "isbn ", "id ", "serial ", "no. ", "total ", "page ")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _holds(kind: int, hit: Column) -> Column:
    """Whether a match of a base pattern counts."""
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    length = F.length(_digits(hit))
    checks = (
        F.lit(True),
        hit.rlike(rf"^{byte}(?:\.{byte}){{3}}$"),
        length.between(13, 19) & F.expr("luhn_check(regexp_replace(hit, '[^0-9]', ''))"),
        length.between(9, 15),
    )
    return checks[kind]


_MATCH = "array<struct<gen:int,skip:int,hit:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """The pieces between a pattern's matches, and the matches."""
    some = text.rlike(hint)
    return F.when(some, F.split(text, pattern, -1)), F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _match(gen: int):
    return lambda h, b: F.struct(F.lit(gen).alias("gen"), b["skip"].alias("skip"), h.alias("hit"), b["before"].alias("before"), b["after"].alias("after"))


def find_matches(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(rid, doc_id, found), a row for each document; generators are numbered base patterns first, then the wide ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    hints = ("@", "[0-9]\\.[0-9]", "[0-9][ -]?[0-9]", "\\+[0-9]", *_HINTS)
    parts = {}
    for g, (pattern, hint) in enumerate(zip(BASE + WIDE, hints, strict=True)):
        parts[f"p{g}"], parts[f"h{g}"] = _matches(F.col("text"), pattern, hint)
    cut = rows.select("rid", "doc_id", *(v.alias(k) for k, v in parts.items()))
    found = []
    for g in range(len(hints)):
        gap = F.transform(f"p{g}", lambda p: F.struct(F.length(p).alias("skip"), F.right(p, F.lit(BEFORE)).alias("before"), F.left(p, F.lit(AFTER)).alias("after")))
        beside = F.zip_with(F.slice(gap, 1, F.size(f"h{g}")), F.slice(gap, 2, F.size(f"h{g}")), lambda a, b: F.struct(a["skip"].alias("skip"), a["before"].alias("before"), b["after"].alias("after")))
        found.append(F.zip_with(f"h{g}", beside, _match(g)))
    every = F.concat(*(F.coalesce(f, F.expr(f"cast(array() as {_MATCH})")) for f in found))
    return scratch.cut(cut.select("rid", "doc_id", every.alias("found")), "matches")


def place_matches(found: DataFrame) -> DataFrame:
    """(rid, gen, kind, start, end, hit, before, after) of the matches, from the lengths between them."""
    rows = found.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("i", "m")).select("rid", "i", "m.*")
    upto = F.sum(F.col("skip") + F.length("hit")).over(Window.partitionBy("rid", "gen").orderBy("i"))
    end = rows.withColumn("end", upto)
    return end.select("rid", "gen", F.pmod("gen", F.lit(len(KINDS))).alias("kind"), (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")


def base_spans(placed: DataFrame) -> DataFrame:
    """Matches of the base patterns that count."""
    sound = F.coalesce(*(F.when(F.col("gen") == g, _holds(g, F.col("hit"))) for g in range(len(BASE))))
    return placed.where(F.col("gen") < len(BASE)).where(sound)


def _pick(words: tuple[str, ...], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.shiftright("h", salt), F.lit(len(words))) + 1).cast("int"))


def _parts(base: DataFrame) -> DataFrame:
    """The different base spans, with the parts that rewritings are made of."""
    keyed = base.select("kind", "hit", "before", "after").distinct().withColumn("h", F.xxhash64("kind", "hit", "before", "after"))
    number = lambda salt, low, high: (F.pmod(F.shiftright("h", salt), F.lit(high - low)) + low).cast("string")
    words = F.concat(F.filter(F.split("before", "[^A-Za-z]+"), lambda w: w != ""), F.array(*map(F.lit, ("then", "more", "some"))))
    return keyed.select(
        "kind", "hit", "before", "after", "h", _digits(F.col("hit")).alias("d"), F.right(_digits(F.col("hit")), F.lit(10)).alias("local"),
        F.array(*(number(s, 10, 99) for s in (3, 7, 11))).alias("two"), F.array(*(number(s, 256, 999) for s in (3, 7, 11, 15))).alias("three"), F.array(number(5, 1900, 2040), number(25, 1900, 2040)).alias("year"),
        F.lpad(number(9, 1, 13), 2, "0").alias("month"), F.lpad(number(13, 1, 29), 2, "0").alias("day"), F.slice(words, 1, 3).alias("w"),
    )


def _wrong_checksum() -> Column:
    return F.concat(F.expr("left(d, length(d) - 1)"), F.pmod(F.right("d", F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))


def _rewritten(kind: int) -> tuple[Column, Column]:
    """Disguises of a base span, and what looks alike and is none."""
    if kind == 0:
        ats = ((" at ", " dot "), (" (at) ", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", "."), (" [at] ", " [dot] "), (" at ", "."), ("@", " dot "), ("@", "[.]"), (" (at) ", " dot "), (" [at] ", "."))
        forms = F.transform(F.array(*(F.struct(F.lit(a).alias("at"), F.lit(b).alias("dot")) for a, b in ats)), lambda x: F.concat(F.substring_index("hit", "@", 1), x["at"], F.replace(F.substring_index("hit", "@", -1), F.lit("."), x["dot"])))
        alike = F.array(F.expr("concat(w[0], ' at ', w[1], '.', initcap(w[2]))"), F.expr("concat(w[1], ' at ', w[2], ' dot ', w[0])"), F.expr("concat(w[2], ' at ', two[0], '.', two[1])"), F.expr("concat(w[0], ' at ', w[2], '.', w[1])"))
    elif kind == 1:
        forms = F.transform(F.array(*map(F.lit, ("[.]", "(.)", " dot ", " [dot] ", "[dot]", "(dot)", "{.}"))), lambda x: F.replace(F.col("hit"), F.lit("."), x))
        alike = F.array(F.replace(F.col("hit"), F.lit("."), F.lit(",")), F.array_join("three", "[.]"), F.array_join("three", "."), F.array_join("three", " dot "))
    elif kind == 2:
        forms = F.array(*(F.regexp_replace("d", "([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in (".", "/", "_", "  ", " - ")))
        alike = F.array(_wrong_checksum(), F.left("d", F.lit(12)), *(F.regexp_replace(_wrong_checksum(), "([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in (".", "/", "_", " ", "-")))
    else:
        shapes = ("($1) $2-$3", "$1-$2-$3", "$1.$2.$3", "$1 $2 $3", "001 $1 $2 $3", "($1)$2-$3", "1-$1-$2-$3")
        forms = F.array(*(F.regexp_replace("local", "^([0-9]{3})([0-9]{3})([0-9]+)$", shape) for shape in shapes))
        alike = F.array(*map(F.expr, (
            "concat_ws('-', year[0], month, day)", "concat_ws('/', day, month, year[0])", "concat_ws('.', day, month, year[1])", "concat_ws(' ', two[0], two[1], two[2])", "left(d, 8)", "local", "concat_ws('.', left(local, 3), right(local, 4))",
            "concat_ws('-', year[0], year[1])", "concat_ws(' ', two[1], left(local, 3), substring(local, 4, 3))", "concat_ws('-', '978', left(d, 2), substring(d, 3, 5), right(d, 2))", "concat_ws('/', left(local, 4), right(local, 3))",
        )))
    return forms, alike


def training_rows(base: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, hit, before, after, label, fold): rewritings of the base spans, as the wide patterns would find them."""
    parts = scratch.cut(_parts(base), "parts")
    out = None
    for kind, wide in enumerate(WIDE):
        forms, alike = _rewritten(kind)
        some = parts.where(F.col("kind") == kind)
        rows = some.select("kind", "h", "before", "after", F.posexplode(forms).alias("i", "hit")).withColumn("label", F.lit(1))
        rows = rows.union(some.select("kind", "h", "before", "after", F.posexplode(alike)).withColumn("label", F.lit(0)))
        if kind == 3:  # the same groups after a word that names something else
            rows = rows.union(rows.where("label = 1").withColumn("label", F.lit(2)))
        own, other = _pick(_CUES[kind], 23), _pick(_OTHER_CUES, 29)
        word = F.when(F.col("label") == 2, other).when(F.pmod(F.shiftright("h", 31) + F.col("i"), F.lit(2)) == 0, F.lit("")).when(F.col("label") == 1, own).otherwise(other)
        rows = rows.select("kind", "hit", F.concat("before", word).alias("before"), "after", (F.col("label") == 1).cast("int").alias("label"), F.pmod("h", F.lit(4)).alias("fold"))
        rows = rows.where(F.col("hit").rlike(f"^(?:{wide})$"))
        out = out.union(rows) if out is not None else rows
    return out


def features() -> dict[str, Column]:
    """Format and context of (kind, hit, before, after), as numbers."""
    hit, digits = F.col("hit"), _digits(F.col("hit"))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    count = lambda pattern: F.length(hit) - F.length(F.regexp_replace(hit, pattern, ""))
    cue = lambda words: F.lower("before").rlike("(?:" + "|".join(w.strip(" :.").replace(".", r"\.") for w in words) + r")[\s:.#]*$")
    made = {
        "kind": F.col("kind"),
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        "last": F.coalesce(F.element_at(sizes, F.when(F.size(sizes) > 0, -1)), F.lit(0)),
        "marks": F.size(F.array_distinct(F.split(F.regexp_replace(hit, "[A-Za-z0-9]", ""), ""))),
        "prefixed": hit.rlike(r"^(?:\+|00)"),
        "opened": hit.contains("("),
        "checksum": F.coalesce(F.expr("luhn_check(regexp_replace(hit, '[^0-9]', ''))"), F.lit(False)),
        "bytes": F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)),
        "bracketed": hit.rlike(r"[(\[{<]\x20?(?:at|AT|dot|DOT|@|\.)\x20?[)\]}>]"),
        "spelled_at": hit.rlike(r"(?i)\x20at\x20"),
        "spelled_dot": hit.rlike(r"(?i)\x20dot\x20"),
        "at_sign": hit.contains("@"),
        "name_marked": hit.rlike(r"^[A-Za-z0-9%+-]*[0-9._%+-]"),
        "labels": count(r"\."),
        "tail": F.length(F.regexp_extract(hit, "([A-Za-z]*)$", 1)),
        "tail_capital": hit.rlike(r"[.\x20][A-Z][a-z]+$"),
        "commas": count(","),
        "hyphens": count("-"),
        "spaces": count(" "),
        "slashes": count("/"),
        "dated": hit.rlike(r"^(?:(?:1[89]|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:1[89]|20)?[0-9]{2})$"),
        "years": hit.rlike(r"^(?:1[89]|20)[0-9]{2}[-/ ](?:1[89]|20)[0-9]{2}$"),
        "own_cue": F.coalesce(*(F.when(F.col("kind") == k, cue(w)) for k, w in enumerate(_CUES))),
        "other_cue": cue(_OTHER_CUES),
        "money": F.col("before").rlike(r"[$€£]\x20?$") | F.col("after").rlike(r"^\x20?[$€£%]"),
        "beside": F.col("before").rlike(r"[^\s(:\[]$") | F.col("after").rlike(r"^[^\s).,;:!?\]]"),
    }
    return {k: v.cast("double") for k, v in made.items()}


def _as_sql(node, names: list[str]) -> str:
    """A fitted tree as nested CASE expressions."""
    if node.numDescendants() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_as_sql(node.leftChild(), names)} ELSE {_as_sql(node.rightChild(), names)} END"


def fit(base: DataFrame, scratch: Scratch) -> tuple[str, dict[int, float]] | None:
    """The score as SQL over the features, and the threshold of each kind; None without enough spans."""
    made = features()
    names = list(made)
    rows = training_rows(base, scratch).select("label", "fold", *(v.alias(k) for k, v in made.items()))
    formats = rows.groupBy("label", (F.col("fold") > 0).alias("fits"), *names).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = scratch.cut(formats.repartition(1).sortWithinPartitions("fits", "label", *names), "training")
    n, good, bad = rows.where("fits").agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") == 1, F.col("weight"))), F.sum(F.when(F.col("label") == 0, F.col("weight")))).first()
    if (good or 0) < LEAST_SPANS or not bad:
        return None
    vector = VectorAssembler(inputCols=names, outputCol="features")
    # with fewer bins than the root of the rows, Spark would look for splits on a sample of them
    bins = max(32, isqrt(n) + 1)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=1, maxBins=bins, seed=1, featureSubsetStrategy="all", weightCol="weight")
    model = learner.fit(vector.transform(rows.where("fits")).select("label", "features", "weight").coalesce(1))
    weighted = zip(model.trees, model.treeWeights, strict=True)
    score = " + ".join(f"{float(w)!r}D * ({_as_sql(t._java_obj.rootNode(), names)})" for t, w in weighted)
    held = rows.where("not fits").select("kind", "label", "weight", F.round(F.expr(score), 6).alias("score")).groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    right = held.select("kind", "score", (F.sum("good").over(above) / F.sum("n").over(above)).alias("precision"))
    least = right.where((F.col("precision") >= PRECISION) & (F.col("score") > 0)).groupBy("kind").agg(F.min("score").alias("least"))
    return score, {int(r.kind): r.least for r in least.collect()}  # four kinds at most


def taken_candidates(placed: DataFrame, base: DataFrame, model: tuple[str, dict[int, float]], scratch: Scratch) -> DataFrame:
    """(rid, kind, start, end): candidates that reach their threshold and overlap no base span and no better candidate."""
    score, least = model
    made = features()
    # features are written, as the trees name each of them many times
    scored = scratch.cut(placed.where(F.col("gen") >= len(BASE)).select("rid", F.col("kind").alias("k"), "start", "end", *(v.alias(k) for k, v in made.items())), "features")
    level = F.coalesce(*(F.when(F.col("k") == k, F.lit(v)) for k, v in least.items())) if least else F.lit(None).cast("double")
    scored = scratch.cut(scored.select("rid", F.col("k").alias("kind"), "start", "end", F.round(F.expr(score), 6).alias("score"), level.alias("level")), "scores")
    good = scored.where("score >= level").drop("level")
    both = good.union(base.select("rid", "kind", "start", "end", F.lit(None).cast("double"))).withColumn("fixed", F.col("score").isNull())
    forward = Window.partitionBy("rid").orderBy("start", F.desc("fixed"), "kind", "end")
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("fixed"), "kind", "end")
    near = both.withColumn("reached", F.max(F.when(F.col("fixed"), F.col("end"))).over(forward)).withColumn("next", F.min(F.when(F.col("fixed"), F.col("start"))).over(back))
    free = near.where("not fixed and (reached is null or reached <= start) and (next is null or next >= end)")
    before = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    chained = free.withColumn("new", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("new").over(Window.partitionBy("rid").orderBy("start", "kind", "end")))
    best = F.row_number().over(Window.partitionBy("rid", "chain").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "kind", "start"))
    return chained.withColumn("place", best).where("place = 1").select("rid", "kind", "start", "end")


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans), a row for each document: arrays of (kind, start, end, base) by kind and start."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = find_matches(docs, id_col, text_col, scratch)
    placed = scratch.cut(place_matches(found), "places")
    base = base_spans(placed)
    model = fit(base, scratch)
    all_spans = base.select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    if model:
        all_spans = all_spans.union(taken_candidates(placed, base, model, scratch).withColumn("base", F.lit(False)))
    per_doc = all_spans.groupBy(F.col("rid").alias("r")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    joined = found.select("rid", "doc_id").join(per_doc, F.col("rid") == F.col("r"), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,base:boolean>>)"))
    return joined.select("doc_id", F.filter(spans, lambda s: s["base"]).alias("base"), spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids and texts with every span replaced by its kind in brackets; of spans that overlap, the one that starts first."""
    scratch = Scratch(docs.sparkSession, "redact")
    rows = scratch.cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "texts")
    spans = find_spans(rows, "rid", "text")
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    # substring counts code points from the start of the text, so a text of m spans is read m times at most
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), name(s["kind"]), F.lit("]")).alias("text"))).otherwise(a)
    joined = rows.join(spans.withColumnRenamed("doc_id", "r").where(F.size("spans") > 0), F.col("rid") == F.col("r"), "left")
    done = F.aggregate(order, start, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return joined.select(F.col("doc_id").alias(id_col), F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias(text_col))


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op12_pii_boosting(docs: DataFrame) -> DataFrame:
    counts = (_of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS))
    return find_spans(docs).select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
