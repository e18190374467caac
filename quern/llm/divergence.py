"""Source divergence audit: how far the word use of a source lies from the other sources of its language.

Sort-based streaming. A task sorts the occurrences of a few megabytes of text by (language, term, source, document)
and scans their runs: a run's length is a count, its number of documents the document frequency, so a task sends a
row for each (language, term, source) in place of one for each occurrence. The rows are dealt by (language, term),
secondary-sorted by source and scanned again: each term's run gives its frequency over the language, which
decides whether the term is kept, and its counts by source. A third scan of the kept runs sums partial values of the
pairs of sources that meet in a run.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that at least
`least_docs` of its documents hold. Of a source, or a language, with N kept occurrences of V kept terms, a term of
count c has the share p = 1 + floor(10^9 (c + 5) / (N + 5 V)); all arithmetic is on integers.

A pair's distance sums |p - q| over all kept terms, most of which one or both sources lack. A source that lacks a
term has the share z it gives a count of 0, so the sum is that of each source's terms against the other's z, plus
|z - z'| for the terms that neither has, corrected on the terms that both have. Only the last part needs pairs in a run,
and these are summed in the task that scans the run; no pair of occurrences, rows or terms is ever made.

Defined results: a null text, language or source counts as ''. Repeated rows are documents of their own, as are rows of
equal or null ids; ids are not read. A text without terms counts for its group alone. A language without kept terms has
pairs of value 0 and no terms. A language of one source has no pairs. An empty table gives an empty result. Ties
are ordered by the item's UTF-8 bytes. Extra columns are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Bytes of text that a task sorts at a time; a longer text is sorted alone.
SORTED_BYTES = 4 << 20
#: Runs that a task holds before it sends them.
HELD_RUNS = 400_000
#: Sources in a block of the pair sums, and blocks of sums that a task holds.
PAIR_BLOCK, HELD_BLOCKS = 512, 32

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal values begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _occurrences(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """The runs of some texts: their occurrences sorted by (language and source, term, document)."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    raw = (text.buffers()[2] or pa.py_buffer(b""))[offsets[0] : offsets[-1]].to_pybytes().translate(_TERMS)
    plain = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw)])
    split = pc.ascii_split_whitespace(plain)
    doc = np.repeat(np.arange(len(text)), split.value_lengths().to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", pa.string())).as_py()
    if empty >= 0:
        code, doc = code[code != empty], doc[code != empty]
    names, group = np.unique(np.array([f"{len(a)}:{a}{b}" for a, b in zip(lang.to_pylist(), source.to_pylist(), strict=True)]), return_inverse=True)
    first = np.full(len(names), -1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]  # a row that has the group's language and source
    groups, docs = len(names), len(text)
    key = np.sort((code * groups + group[doc]) * docs + doc)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    in_doc, run = np.diff(at, append=len(key)), key[at] // docs
    begin = np.flatnonzero(np.diff(run, prepend=-1))
    df = np.diff(begin, append=len(run))
    n = np.add.reduceat(in_doc, begin) if len(begin) else np.zeros(0, np.int64)
    # an empty term stands for the group itself
    rows = np.concatenate([first[run[begin] % groups], first])
    term = pa.concat_arrays([coded.dictionary.take(pa.array(run[begin] // groups)), pa.array([""] * groups, pa.string())])
    zero = np.zeros(groups, np.int64)
    return pa.table([lang.take(pa.array(rows)), term, source.take(pa.array(rows)), np.concatenate([df, zero]), np.concatenate([n, zero])], schema=_RUN)


def _summed(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["lang", "term", "source"], use_threads=False).aggregate([("df", "sum"), ("n", "sum")])
    return pa.table([found["lang"], found["term"], found["source"], found["df_sum"], found["n_sum"]], schema=_RUN)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to runs, each sent when the task ends or holds too many."""
    held, rows = [], 0
    for batch in batches:
        lang, source, text = (batch.column(i).cast(pa.string()) for i in range(3))
        upto = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(text):
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + SORTED_BYTES, "right")))
            held.append(_occurrences(lang[at:end], source[at:end], text[at:end]))
            rows, at = rows + held[-1].num_rows, end
            if rows > HELD_RUNS:
                held = [_summed(held)]
                if (rows := held[0].num_rows) > HELD_RUNS // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from _summed(held).combine_chunks().to_batches()


def _whole_runs(batches: Iterator[pa.RecordBatch], reduce) -> Iterator[pa.Table]:
    """Tables that end where a (lang, term) run ends; what waits for its end is reduced first."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = reduce((pa.concat_tables([carry, table]) if carry is not None else table).combine_chunks())
        last = int(_starts(*(c.combine_chunks() for c in (table["lang"], table["term"])))[-1]) if table.num_rows else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        carry = table.slice(last)
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def _merged(table: pa.Table) -> pa.Table:
    """Adjacent rows of one (lang, term, source) as one."""
    at = _starts(*(_column(table, c) for c in ("lang", "term", "source")))
    if len(at) == table.num_rows:
        return table
    sums = [np.add.reduceat(_column(table, c).to_numpy(), at) for c in ("df", "n")]
    picked = table.take(pa.array(at))
    return pa.table([picked["lang"], picked["term"], picked["source"], *sums], schema=_RUN)


def _keep(least: int):
    """Sorted runs to (lang, term, source, n, lang_n, first) of the terms that enough documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs((pa.record_batch([b.column(i).cast(_RUN.field(i).type) for i in range(5)], schema=_RUN) for b in batches), _merged):
            at = _starts(_column(table, "lang"), _column(table, "term"))
            sizes = np.diff(at, append=table.num_rows)
            df, n = (np.add.reduceat(_column(table, c).to_numpy(), at) for c in ("df", "n"))
            group = pc.equal(_column(table, "term"), "").to_numpy(zero_copy_only=False)
            good = np.repeat(df >= least, sizes) | group
            first = np.zeros(table.num_rows, bool)
            first[at] = True
            out = [_column(table, c) for c in ("lang", "term", "source", "n")]
            yield from pa.table([*out, np.repeat(n, sizes), first], names=["lang", "term", "source", "n", "lang_n", "first"]).filter(pa.array(good)).combine_chunks().to_batches()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term, source, p, z) to partial sums (lang, a, b, value) of what a term adds that both sources have."""
    numbers: dict[str, dict[str, int]] = {}
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), block in sums.items():
            names = list(numbers[lang])
            a, b = np.nonzero(block)
            sides = [pa.array([names[x] for x in side], pa.string()) for side in (a + i * PAIR_BLOCK, b + j * PAIR_BLOCK)]
            yield pa.record_batch([pa.array([lang] * len(a), pa.string()), *sides, pa.array(block[a, b])], names=["lang", "a", "b", "value"])
        sums.clear()

    for table in _whole_runs(batches, lambda t: t):
        at = _starts(_column(table, "lang"), _column(table, "term"))
        lang, source = table["lang"].to_pylist(), table["source"].to_pylist()
        p, z = _column(table, "p").to_numpy(), _column(table, "z").to_numpy()
        for begin, end in zip(at, [*at[1:], table.num_rows], strict=True):
            if end - begin < 2:
                continue
            known = numbers.setdefault(lang[begin], {})
            place = np.array([known.setdefault(s, len(known)) for s in source[begin:end]])
            block, inside = place // PAIR_BLOCK, place % PAIR_BLOCK
            own_p, own_z = p[begin:end], z[begin:end]
            for i in np.unique(block):
                for j in np.unique(block):
                    r, c = np.flatnonzero(block == i), np.flatnonzero(block == j)
                    pr, zr, pc_, zc = own_p[r][:, None], own_z[r][:, None], own_p[c][None, :], own_z[c][None, :]
                    value = abs(pr - pc_) - abs(pr - zc) - abs(zr - pc_) + abs(zr - zc)
                    key = (lang[begin], int(i), int(j))
                    if key not in sums and len(sums) >= HELD_BLOCKS:
                        yield from flush()
                    sums.setdefault(key, np.zeros((PAIR_BLOCK, PAIR_BLOCK), np.int64))[np.ix_(inside[r], inside[c])] += value
    yield from flush()


def _share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)) on integers of 38 digits; null where nothing is kept."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"case when {kept} > 0 then cast((cast({SCALE} as decimal(10, 0)) * {wide(f'{count} + {PRIOR}')}) div {wide(f'{total} + {PRIOR} * {kept}')} as bigint) + 1 end")


def kept_runs(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, first): counts of the kept terms by source, and an empty term for each group that occurs."""
    cleaned = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = cleaned.mapInArrow(_count, "lang string, term string, source string, df long, n long")
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return scratch.cut(dealt.mapInArrow(_keep(least_docs), "lang string, term string, source string, n long, lang_n long, first boolean"), "kept")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms that a source has more than its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = kept_runs(docs, scratch, least_docs)
    terms = kept.where("term <> ''")
    langs = terms.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("all_n"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("own_terms"))
    groups = kept.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "all_n", "own_n", "own_terms"])
    groups = scratch.cut(groups.withColumn("z", _share("0L", "own_n", "v")), "groups")
    shares = terms.join(groups, ["lang", "source"]).select("lang", "term", "source", _share("n", "own_n", "v").alias("p"), "z", _share("lang_n", "all_n", "v").alias("q"))
    shares = scratch.cut(shares, "shares")
    # each source's terms against the share of a term that the other lacks
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"), F.col("own_terms").alias("terms2"))
    one_sided = levels.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("z2"))).alias("one"))
    dealt = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = dealt.mapInArrow(_pairs, "lang string, a string, b string, value long").groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("both"))
    neither = (F.col("v") - F.col("own_terms") - F.col("terms2")) * F.abs(F.col("z") - F.col("z2"))
    every = groups.select("lang", "source", "v", "z", "own_terms").join(other, "lang").where("source <> item").select("lang", "source", "item", neither.alias("neither"))
    parts = every.join(one_sided, ["lang", "source", "item"], "left").join(shared, ["lang", "source", "item"], "left")
    parts = parts.join(one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("back")), ["lang", "source", "item"], "left")
    total = sum((F.coalesce(c, F.lit(0)) for c in ("one", "back", "both")), F.coalesce("neither", F.lit(0)))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.select("lang", "source", F.lit("pair").alias("part"), "item", total.cast("long").alias("value")).withColumn("rank", F.row_number().over(place))
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.union(over.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_terms))


def op11_source_divergence(docs: DataFrame) -> DataFrame:
    return audit(docs)
