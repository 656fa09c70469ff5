"""Rolling totals over trailing periods by segment trees.

Each (entity, time shard of 64 days) holds one segment tree over its days, with
a sum and a count in every node.  A trailing window touches at most two shards;
inside a shard it is the sum of O(log 64) canonical nodes.  Trees of many
entities lie side by side in one matrix per level, so that a query for all days
of all entities is a few vector additions.  A late correction changes one leaf
and its ancestors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 64
LEVELS = SHARD.bit_length()  # 64 leaves: levels 0..6
WINDOWS = (7, 30)


def canonical_nodes(lo: int, hi: int) -> list[tuple[int, int]]:
    """The (level, index) nodes whose ranges tile [lo, hi], both inclusive, in a tree of SHARD leaves."""
    nodes: list[tuple[int, int]] = []
    level = 0
    hi += 1
    while lo < hi:
        if lo & 1:
            nodes.append((level, lo))
            lo += 1
        if hi & 1:
            hi -= 1
            nodes.append((level, hi))
        lo >>= 1
        hi >>= 1
        level += 1
    return nodes


def build_levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Levels of many trees at once; ``leaves`` has one row per day of the shard, one column per tree."""
    levels = [leaves]
    while levels[-1].shape[0] > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    return levels


def flat_tree(levels: list[np.ndarray]) -> np.ndarray:
    """One tree per row: leaves first, the root last (2 x SHARD - 1 nodes)."""
    return np.concatenate(levels, axis=0).T


def ancestors(leaf: int) -> list[int]:
    """Positions in ``flat_tree`` of a leaf and its ancestors."""
    out, base, size, i = [], 0, SHARD, leaf
    while size:
        out.append(base + i)
        base += size
        size >>= 1
        i >>= 1
    return out


def window_sums(levels: list[np.ndarray], previous: np.ndarray, width: int) -> np.ndarray:
    """For each day of each tree, the total of the ``width`` days ending on it.

    ``previous`` gives for each tree the column of the shard before it, or the
    index of the last column, which must be all zero, where there is none.
    """
    out = np.zeros_like(levels[0])
    for i in range(SHARD):
        for level, k in canonical_nodes(max(0, i - width + 1), i):
            out[i] += levels[level][k]
        if i - width + 1 < 0:
            for level, k in canonical_nodes(SHARD + i - width + 1, SHARD - 1):
                out[i] += levels[level][k][previous]
    return out


def daily(visits: DataFrame, entity: str, date_text: str, amount: str) -> DataFrame:
    """(entity, day, total, n): one row for each entity and real date; days whose amounts are all left out have n = 0.

    A date counts if it is written yyyy-mm-dd and exists.  Null, NaN and
    infinite amounts are left out; the visit itself still extends the span.
    """
    day = F.when(F.col(date_text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(date_text).try_cast("date"))
    value = F.col(amount)
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return (
        visits.where(F.col(entity).isNotNull())
        .select(F.col(entity).alias("entity"), F.unix_date(day).alias("day"), F.when(good, value).alias("v"))
        .where(F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.count("v").alias("n"))
    )


def _answers(entities: pa.Array, first: np.ndarray, last: np.ndarray, base: np.ndarray, tree_s: list[np.ndarray], tree_n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per entity and day from its first to its last, from the levels of its trees.

    Entity k has the columns base[k] to base[k + 1] of every level, one per shard
    in time order; the last column of all is zero throughout.
    """
    trees = int(base[-1])
    previous = np.arange(trees + 1) - 1
    previous[base[:-1]] = trees
    previous[trees] = trees
    owner = np.repeat(np.arange(len(first)), np.diff(base))
    shard = np.arange(trees) - base[owner] + (first // SHARD)[owner]
    days = shard[:, None] * SHARD + np.arange(SHARD)
    inside = (days >= first[owner][:, None]) & (days <= last[owner][:, None])
    who = pa.array(np.broadcast_to(owner[:, None], inside.shape)[inside].astype(np.int32))
    low = int(first.min())
    calendar = pa.array(np.datetime_as_string(np.arange(low, int(last.max()) + 1).astype("datetime64[D]")))
    columns = [entities.take(who), calendar.take(pa.array((days[inside] - low).astype(np.int32)))]
    for width in WINDOWS:
        t = np.round(window_sums(tree_s, previous, width)[:, :trees].T[inside], 2) + 0.0
        c = window_sums(tree_n, previous, width)[:, :trees].T[inside]
        with np.errstate(divide="ignore", invalid="ignore"):
            columns += [pa.array(np.where(c > 0, t, 0.0)), pa.array(t / c, mask=c == 0)]
    names = ["entity", "day"] + [f"{k}_{w}" for w in WINDOWS for k in ("total", "avg")]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, 65536):
        yield whole.slice(at, 65536)


def _totals(entities: pa.Array, start: np.ndarray, day: np.ndarray, total: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Days of whole entities, sorted, into trees and these into answers; ``start`` has where each entity begins, and the end."""
    first, last = day[start[:-1]], day[start[1:] - 1]
    base = np.concatenate(([0], np.cumsum(last // SHARD - first // SHARD + 1)))
    of = np.repeat(np.arange(len(first)), np.diff(start))
    column = base[of] + day // SHARD - (first // SHARD)[of]
    sums, counts = np.zeros((SHARD, base[-1] + 1)), np.zeros((SHARD, base[-1] + 1))
    sums[day % SHARD, column] = total
    counts[day % SHARD, column] = n
    yield from _answers(entities, first, last, base, build_levels(sums), build_levels(counts))


def _stored(entities: pa.Array, start: np.ndarray, shard: np.ndarray, first_day: np.ndarray, last_day: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stored trees of whole entities into answers: their nodes are taken as they are; shards that are not stored are zero."""
    first, last = first_day[start[:-1]], last_day[start[1:] - 1]
    base = np.concatenate(([0], np.cumsum(last // SHARD - first // SHARD + 1)))
    of = np.repeat(np.arange(len(first)), np.diff(start))
    column = base[of] + shard - (first // SHARD)[of]
    levels = []
    for nodes in (sums, counts):
        whole = np.zeros((2 * SHARD - 1, base[-1] + 1))
        whole[:, column] = nodes.T
        levels.append(np.split(whole, np.cumsum([SHARD >> k for k in range(LEVELS - 1)])))
    yield from _answers(entities, first, last, base, *levels)


MOST_ROWS, MOST_TREES = 8192, 16384


def whole_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole entities from batches sorted by entity: the rows of a batch's last entity wait for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(b.schema.get_field_index("entity"))
        last = names[len(names) - 1].as_py()
        at = b.num_rows
        while at and names[at - 1].as_py() == last:
            at -= 1
        if at or held and held[-1].column(held[-1].schema.get_field_index("entity"))[-1].as_py() != last:
            yield pa.Table.from_batches([*held, b.slice(0, at)]).combine_chunks()
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spans(t: pa.Table, first_shard: np.ndarray, last_shard: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, int, int]]:
    """(entities, starts, from row, to row): some thousand rows and trees at a time bound the matrices; an entity stays whole."""
    names = t.column("entity").combine_chunks()
    names = names.dictionary_encode() if not isinstance(names, pa.ChunkedArray) else names.combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]))
    trees = np.concatenate(([0], np.cumsum(last_shard[starts[1:] - 1] - first_shard[starts[:-1]] + 1)))
    k = 0
    while k < len(starts) - 1:
        e = min(int(np.searchsorted(starts, starts[k] + MOST_ROWS, side="right")), int(np.searchsorted(trees, trees[k] + MOST_TREES, side="right"))) - 1
        e = max(k + 1, e)
        yield names.dictionary.take(pa.array(codes[starts[k:e]])), starts[k : e + 1] - starts[k], int(starts[k]), int(starts[e])
        k = e


def trailing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (entity, day, total, n) batches in, one row per entity and day of its span out; an entity has at most one row per day."""
    for t in whole_entities(batches):
        if not t.num_rows:
            continue
        day, total, n = (t.column(c).to_numpy() for c in ("day", "total", "n"))
        day = day.astype(np.int64)
        for entities, starts, a, b in _spans(t, day // SHARD, day // SHARD):
            yield from _totals(entities, starts, day[a:b], total[a:b], n[a:b])


def stored_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from stored trees, sorted by entity and shard."""
    for t in whole_entities(batches):
        if not t.num_rows:
            continue
        shard, first, last = (t.column(c).to_numpy().astype(np.int64) for c in ("shard", "first_day", "last_day"))
        nodes = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in ("sums", "counts")]
        for entities, starts, a, b in _spans(t, shard, shard):
            yield from _stored(entities, starts, shard[a:b], first[a:b], last[a:b], *[x[a:b] for x in nodes])


TOTALS_SCHEMA = "entity string, day string, " + ", ".join(f"total_{w} double, avg_{w} double" for w in WINDOWS)


def trailing_totals(days: DataFrame) -> DataFrame:
    """Totals and averages over the trailing windows for each entity and each day (yyyy-mm-dd) from its first to its last.

    Totals are rounded to cents and 0.0 where nothing counts; averages are null there.
    """
    ordered = days.select("entity", "day", "total", "n").repartition("entity").sortWithinPartitions("entity", "day")
    return ordered.mapInArrow(trailing_batches, TOTALS_SCHEMA)


def trailing_from_trees(trees: DataFrame) -> DataFrame:
    """What ``trailing_totals`` gives, answered from stored trees, corrected ones too: every window is a few of their nodes."""
    ordered = trees.repartition("entity").sortWithinPartitions("entity", "shard")
    return ordered.mapInArrow(stored_batches, TOTALS_SCHEMA)


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        flat: dict[str, pa.Array] = {}
        for name in ("total", "n"):
            leaves = np.zeros((SHARD, rows))
            lists = b.column(b.schema.get_field_index("days"))
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            at = values.field("day").to_numpy(zero_copy_only=False) % SHARD
            leaves[at, np.repeat(np.arange(rows), lengths)] = values.field(name).to_numpy(zero_copy_only=False)
            nodes = flat_tree(build_levels(leaves)).ravel()
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * (2 * SHARD - 1))
            flat[name] = pa.ListArray.from_arrays(offsets, pa.array(nodes))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(c)) for c in ("entity", "shard", "first_day", "last_day")], flat["total"], flat["n"]],
            names=["entity", "shard", "first_day", "last_day", "sums", "counts"],
        )


TREE_SCHEMA = "entity string, shard int, first_day int, last_day int, sums array<double>, counts array<double>"


def sharded(days: DataFrame) -> DataFrame:
    """One row per entity and shard with its days (64 at most)."""
    return (
        days.withColumn("shard", F.floor(F.col("day") / SHARD).cast("int"))
        .groupBy("entity", "shard")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.collect_list(F.struct("day", "total", "n")).alias("days"))
    )


def segment_trees(days: DataFrame) -> DataFrame:
    """The stored form: one tree per entity and shard, all nodes flat, leaves first, root last, with the first and last day that has a row."""
    return sharded(days).select("entity", "shard", "first_day", "last_day", "days").mapInArrow(_tree_rows, TREE_SCHEMA)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            sums, counts = list(r["sums"] or [0.0] * (2 * SHARD - 1)), list(r["counts"] or [0.0] * (2 * SHARD - 1))
            for x in r.pop("days"):
                for k in ancestors(x["day"] % SHARD):
                    sums[k] += x["total"]
                    counts[k] += x["n"]
            r["sums"], r["counts"] = sums, counts
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("entity", pa.string()), ("shard", pa.int32()), ("first_day", pa.int32()), ("last_day", pa.int32()), ("sums", pa.list_(pa.float64())), ("counts", pa.list_(pa.float64()))]))


def apply_corrections(trees: DataFrame, late: DataFrame) -> DataFrame:
    """Trees after late rows (entity, day, total, n): only touched trees enter Python, and there only a leaf's ancestors change."""
    delta = sharded(late).withColumnsRenamed({"first_day": "_first", "last_day": "_last"})
    touched = trees.join(delta, ["entity", "shard"], "right").select(
        "entity", "shard", F.least("first_day", "_first").alias("first_day"), F.greatest("last_day", "_last").alias("last_day"), "sums", "counts", "days"
    )
    rest = trees.join(delta.select("entity", "shard"), ["entity", "shard"], "left_anti")
    return rest.unionByName(touched.mapInArrow(_corrected, TREE_SCHEMA))
