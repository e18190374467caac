"""Links between records and a metadata table by an exact date and the names of two parties."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.edits import distances

# Weights of the two parties, and the scores from which a link counts as sure or as worth a look.
FIRST_WEIGHT, SECOND_WEIGHT = 0.55, 0.45
SURE, LOOK = 85.0, 65.0
#: Names of a side that a task has at a time; those whose whole tables of distances it makes at a time, and rows of scores made of them.
BLOCK, TABLE, STEP = 32768, 2048, 256
#: Distances that a task holds at a time, and pairs of rows for each pair of cells that make cells worth while.
HELD, CELL = 1 << 22, 1024
#: Scores this near to a block's best are handed on, as they may round to the same.
SLACK = 2e-6


def edit_similarity(a: Column, b: Column) -> Column:
    """From 0 to 100: edits over the longer name; 100 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def sequence_similarity(a: Column, b: Column) -> Column:
    """From 0 to 100: the Ratcliff-Obershelp ratio, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda p, q: 100.0 * SequenceMatcher(None, p, q).ratio()).astype("float64")

    return ratio(a, b)


def _named(table: DataFrame, columns: tuple[str, str, str, str], prefix: str) -> DataFrame:
    key, date, first, second = columns
    return table.select(F.col(key).alias(f"{prefix}id"), F.to_date(F.col(date)).alias(f"{prefix}date"), T.party_name(first).alias(f"{prefix}first"), T.party_name(second).alias(f"{prefix}second"))


def _blocks(table: DataFrame, own: str, other: str, n_own: Column, n_other: Column) -> DataFrame:
    """Each row in its block of its group, once for each block of the other side; some BLOCK rows a block."""
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("first", "second"), count(n_own)).cast("int").alias(own)
    return table.select("*", mine, F.explode(F.sequence(F.lit(0), count(n_other) - 1)).alias(other))


def _best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best scores of each left pair of names over the right ones, with the rows that have them and the least id."""
    right = right.sort_by("least")
    n, m = left.num_rows, right.num_rows
    if n and m:
        sides = [[t.column(c).to_pylist() for c in ("first", "second")] for t in (left, right)]
        cells = [len({(len(x), y) for x, y in zip(*side, strict=True)}) for side in sides]
        if cells[0] * cells[1] * CELL <= n * m:
            return _best_of_cells(left, right, *sides)
    parts = [_best_of_tables(left.slice(i, TABLE), right.slice(j, TABLE)) for i in range(0, max(n, 1), TABLE) for j in range(0, max(m, 1), TABLE)]
    return pa.concat_tables(parts)


def _similar(edits: np.ndarray, longest: np.ndarray | int) -> np.ndarray:
    return np.where(longest == 0, 100.0, 100.0 * (1 - edits / np.maximum(longest, 1)))


def _runs(values: np.ndarray) -> list[slice]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _best_of_cells(left: pa.Table, right: pa.Table, asked: list[list[str]], held: list[list[str]]) -> pa.Table:
    """As _best_of_tables(), where few second names and lengths make cells of many rows.

    Lengths bound the first similarity, and between two second names the other is fixed, so in a cell a score is a falling function of the
    edits alone. Lengths are taken from the nearest on, likely second names before others, and only for rows whose best score can be reached.
    """
    (firsts, others), coded, names = (asked[0], held[0]), [], []
    for side in (asked, held):
        name, code = np.unique(np.array(side[1], object), return_inverse=True)
        names.append(list(name))
        coded.append(code)
    lengths = [np.array([len(x) for x in side], np.int64) for side in names]
    second = _similar(distances(*names), np.maximum(lengths[0][:, None], lengths[1]))
    lone = [np.array([x == "" for x in side], bool) for side in names]
    # the likeliest second names of the right side first, rows of one together, in the order of their first names
    likely = np.argsort(np.argsort(-second[~lone[0]].max(axis=0, initial=0.0), kind="stable"))
    groups = []
    for side, rank in ((asked, coded[0]), (held, likely[coded[1]])):
        sizes = np.array([len(x) for x in side[0]], np.int64)
        order = sorted(range(len(sizes)), key=list(zip(sizes.tolist(), rank.tolist(), side[0], strict=True)).__getitem__)
        groups.append([np.array(order[x]) for x in _runs(sizes[order])])
    found = []
    for mine in groups[0]:
        size = len(firsts[mine[0]])
        best = np.full(len(mine), -np.inf)
        hits = []
        for theirs in sorted(groups[1], key=lambda g: abs(size - len(others[g[0]])) / max(size, len(others[g[0]]), 1)):
            other = len(others[theirs[0]])
            longest = max(size, other)
            first = _similar(np.arange(longest + 1), longest)

            def score(q, b, first=first):
                return first if lone[0][q] or lone[1][b] else FIRST_WEIGHT * first + SECOND_WEIGHT * second[q, b]

            top = first[abs(size - other)]
            bounds = np.where(lone[0][:, None] | lone[1], top, FIRST_WEIGHT * top + SECOND_WEIGHT * second)
            at = 0
            while at < len(theirs):
                # rows that something from here on may reach decide how many names are taken
                left_names = np.unique(coded[1][theirs[at:]])
                most = len(np.flatnonzero(best - SLACK <= bounds[:, left_names].max(axis=1)[coded[0][mine]]))
                if not most:
                    break
                part = theirs[at : at + max(1, HELD // most)]
                at += len(part)
                need = np.flatnonzero(best - SLACK <= bounds[:, np.unique(coded[1][part])].max(axis=1)[coded[0][mine]])
                if not len(need):
                    continue
                x, y = [firsts[k] for k in mine[need].tolist()], [others[k] for k in part.tolist()]
                # the larger side takes the smaller one's characters
                edits = distances(x, y) if len(x) >= len(y) else distances(y, x).T
                for rows in _runs(coded[0][mine[need]]):
                    q = coded[0][mine[need[rows.start]]]
                    for cols in [slice(0, len(part))] if lone[0][q] else _runs(coded[1][part]):
                        b = coded[1][part[cols.start]]
                        own = need[rows]
                        if not lone[0][q] and bounds[q, b] < best[own].min() - SLACK:
                            continue
                        scores, cell = score(q, b), edits[rows, cols]
                        best[own] = np.maximum(best[own], scores[cell.min(axis=1)])
                        # the most edits of a row whose score is as good
                        limit = np.searchsorted(-scores, SLACK - best[own], "right") - 1
                        i, j = np.nonzero(cell <= limit[:, None])
                        hits.append((own[i], scores[cell[i, j]], part[cols][j]))
        i, s, j = (np.concatenate(x) for x in zip(*hits, strict=True))
        kept = s >= best[i] - SLACK
        found.append((mine[i[kept]], s[kept], j[kept]))
    i, s, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, s, i))
    i, j, s = i[order], j[order], s[order]
    starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])]))
    out = left.select(["group", "first", "second"]).take(pa.array(i[starts]))
    out = out.append_column("score", pa.array(s[starts])).append_column("rows", pa.array(np.add.reduceat(right.column("rows").to_numpy()[j], starts)))
    return out.append_column("least", right.column("least").take(pa.array(j[starts])))


def _best_of_tables(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best scores by whole tables of distances; `right` is sorted by `least`."""
    n, m = left.num_rows, right.num_rows
    coded = {}
    for side, table in (("l", left), ("r", right)):
        for name in ("first", "second"):
            d = table.column(name).combine_chunks().dictionary_encode()
            coded[side + name] = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)
    tables = {}
    for name in ("first", "second"):
        x, y = coded["l" + name][0], coded["r" + name][0]
        edits = distances(x, y) if n and m else np.zeros((len(x), len(y)), np.int32)
        longest = np.maximum(np.array([len(s) for s in x], np.int32)[:, None], np.array([len(s) for s in y], np.int32))
        tables[name] = _similar(edits, longest)
    lone_l, lone_r = (np.array([s == "" for s in coded[side][0]], bool)[coded[side][1]] for side in ("lsecond", "rsecond"))
    rows, at, scores, sums, least = right.column("rows").to_numpy(), [], [], [], []
    for low in range(0, n if m else 0, STEP):
        pick = slice(low, low + STEP)
        first, second = (tables[name][coded["l" + name][1][pick]][:, coded["r" + name][1]] for name in ("first", "second"))
        score = np.where(lone_l[pick, None] | lone_r, first, FIRST_WEIGHT * first + SECOND_WEIGHT * second)
        i, j = np.nonzero(score >= score.max(1, keepdims=True) - SLACK)
        s = score[i, j]
        order = np.lexsort((j, s, i))
        i, j, s = i[order], j[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])]))
        at.append(i[starts] + low)
        scores.append(s[starts])
        sums.append(np.add.reduceat(rows[j], starts))
        least.append(j[starts])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    out = left.select(["group", "first", "second"]).take(pa.array(join(at, np.int64)))
    out = out.append_column("score", pa.array(join(scores, np.float64))).append_column("rows", pa.array(join(sums, np.int64)))
    return out.append_column("least", right.column("least").take(pa.array(join(least, np.int64))))


def best_by_edits(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(group, first, second, score, rows, least): for each asked pair of names its best scores among the held ones of its group.

    `asked` has distinct (group, first, second); `held` has them with `rows` and `least`. All pairs of a group are scored by edits,
    in blocks of names of both sides, which tasks share; several rows come for one pair of names: one from each block, and scores
    that differ by less than SLACK. The caller rounds and takes the best.
    """
    spark = asked.sparkSession
    sizes = lambda t, name: t.groupBy(F.col("group").alias(f"g_{name}")).agg(F.count(F.lit(1)).alias(name))
    both = sizes(asked, "n").join(sizes(held, "m"), F.col("g_n") == F.col("g_m")).drop("g_m")
    # the rows are few beside the pairs that they make, so their bytes must not decide on the tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["group", "lb", "rb"]
    sides = []
    for table, own, other, a, b in ((asked, "lb", "rb", "n", "m"), (held, "rb", "lb", "m", "n")):
        there = table.join(both, F.col("group") == F.col("g_n"))
        sides.append(_blocks(there, own, other, F.col(a), F.col(b)).drop("g_n", "n", "m").repartition(tasks, *keys))
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    out = f"`group` {kind(asked, 'group')}, first string, second string, score double, rows long, least {kind(held, 'least')}"
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(_best_of_block, out)


def nearest_name(asked: DataFrame, held: DataFrame, group: str, name: str, held_group: str, held_name: str, key: str) -> DataFrame:
    """(group, first, least, name, edits): for each name of `asked` the most similar one of its group in `held`, by edits over the longer name.

    The smallest key wins among equals. Names without a character meet as equals of nothing: two empty ones are no pair.
    """
    named = asked.select(F.col(group).alias("group"), F.col(name).alias("first"), F.lit("").alias("second")).where("group is not null and first is not null").distinct()
    keyed = held.select(F.col(held_group).alias("group"), F.col(held_name).alias("first"), F.lit("").alias("second"), F.col(key).alias("least")).where("group is not null and first is not null")
    keyed = keyed.groupBy("group", "first", "second").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("rows"))
    found = best_by_edits(named.where("first <> ''"), keyed).unionByName(
        named.where("first = ''").join(keyed.where("first <> ''").groupBy("group").agg(F.min("least").alias("least")), "group").select("group", "first", "second", F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rows"), "least")
    )
    best = found.groupBy("group", "first").agg(F.min(F.struct((-F.col("score")).alias("worse"), "least")).alias("b")).select("group", "first", "b.least")
    names = keyed.select(F.col("least").alias("k"), F.col("group").alias("g"), F.col("first").alias("name"))
    return best.join(names, (F.col("least") == F.col("k")) & (F.col("group") == F.col("g"))).select("group", "first", "least", "name", F.levenshtein("first", "name").alias("edits"))


def link_by_date(
    records: DataFrame, metadata: DataFrame, record_columns: tuple[str, str, str, str], metadata_columns: tuple[str, str, str, str], similarity: Callable[[Column, Column], Column] = edit_similarity
) -> DataFrame:
    """(id, candidates, score, status, match, ties), a row for each record.

    Columns are given as (id, date, first party, second party). Candidates are the metadata rows of the record's day. A pair scores
    0.55 of the first parties' similarity and 0.45 of the second's, or the first's alone where a second party is empty on either
    side. The best score wins, the smallest id among equals; `ties` counts the rows that reach it. A record without a date, or
    whose day has no metadata, is NO_MATCH with nulls and no candidates. Names are compared once for each distinct pair of a
    day, so records or metadata that repeat add nothing. Edits are counted by `best_by_edits` in blocks; any other similarity goes pair by pair.
    """
    own = _named(records, record_columns, "r_")
    asked = own.where("r_date is not null").select("r_date", "r_first", "r_second").distinct()
    held = _named(metadata, metadata_columns, "m_").where("m_date is not null").groupBy("m_date", "m_first", "m_second").agg(F.min("m_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    keys = ["r_date", "r_first", "r_second"]
    if similarity is edit_similarity:
        found = best_by_edits(
            asked.select(F.col("r_date").alias("group"), F.col("r_first").alias("first"), F.col("r_second").alias("second")),
            held.select(F.col("m_date").alias("group"), F.col("m_first").alias("first"), F.col("m_second").alias("second"), "least", "rows"),
        )
        scored = found.select(F.col("group").alias("r_date"), F.col("first").alias("r_first"), F.col("second").alias("r_second"), F.round("score", 6).alias("score"), "rows", "least")
    else:
        tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * own.sparkSession.sparkContext.defaultParallelism)
        pairs = asked.repartition(tasks, "r_date").join(held.repartition(tasks, "m_date"), F.col("r_date") == F.col("m_date"))
        first = similarity(F.col("r_first"), F.col("m_first"))
        both = FIRST_WEIGHT * first + SECOND_WEIGHT * similarity(F.col("r_second"), F.col("m_second"))
        scored = pairs.withColumn("score", F.round(F.when((F.col("r_second") == "") | (F.col("m_second") == ""), first).otherwise(both), 6))
    by_score = scored.groupBy(*keys, "score").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"))
    of_day = held.groupBy("m_date").agg(F.sum("rows").alias("candidates"))
    best = by_score.groupBy(*keys).agg(F.max(F.struct("score", "rows", "least")).alias("best")).join(of_day, F.col("r_date") == F.col("m_date"))
    best = best.select(F.col("r_date").alias("d"), F.col("r_first").alias("f"), F.col("r_second").alias("s"), "candidates", "best.*")
    joined = own.join(best, (F.col("r_date") == F.col("d")) & (F.col("r_first") == F.col("f")) & (F.col("r_second") == F.col("s")), "left")
    s = F.col("score")
    status = F.when(s.isNull(), "NO_MATCH").when(s >= SURE, "HIGH_CONFIDENCE").when(s >= LOOK, "REVIEW").otherwise("LOW_CONFIDENCE")
    return joined.select(
        F.col("r_id").alias("id"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.round("score", 2).alias("score"), status.alias("status"), F.col("least").alias("match"), F.coalesce("rows", F.lit(0)).cast("long").alias("ties")
    )
