"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths decides (at most ``capacity`` entries, so it fits
anywhere): patterns of few distinct lengths that fill a container exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least
squares, rounded down, and what is left is packed by the best filling pattern
that can still be formed.  The items then take their places by rank within
their length, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.session import durable

CAPACITY = 2048
FILLERS = 24  # lengths tried as the second member of a pattern
SHORT_WEIGHT = 0.1  # residuals of short items weigh less: they fill gaps easily
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 64  # a length's items are ranked in independent parts of about so many rows, in so many parts at least


@dataclass
class Plan:
    """``patterns`` rows: containers, then (length, times) pairs; see ``segments`` for the places they give."""

    counts: np.ndarray  # how often each pattern is used
    lengths: list[np.ndarray]  # the distinct lengths of each pattern, longest first
    times: list[np.ndarray]

    @property
    def containers(self) -> int:
        return int(self.counts.sum())


def enumerate_patterns(hist: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (up to three distinct lengths with multiplicities) that fill ``capacity`` exactly; arrays [n, 3]."""
    present = np.flatnonzero(hist)
    frequent = present[np.argsort(-hist[present], kind="stable")][:FILLERS]
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    out_l, out_t = [], []

    def add(a, m, b, n, c):
        ok = (c > 0) & have[np.clip(c, 0, capacity)] & (a != b) & (b != c) & (a != c)
        if ok.any():
            full = np.broadcast_arrays(a, m, b, n, c)
            a, m, b, n, c = (x[ok] for x in full)
            out_l.append(np.stack([a, b, c], 1))
            out_t.append(np.stack([m, n, np.ones_like(c)], 1))

    most = capacity // present
    for a, m_most in zip(present, most, strict=True):
        for m in sorted({int(m_most), max(1, int(m_most) - 1), max(1, int(m_most) // 2), 1}):
            rest = capacity - m * a
            if rest < 0:
                continue
            if rest == 0:
                out_l.append(np.array([[a, 0, 0]]))
                out_t.append(np.array([[m, 0, 0]]))
                continue
            if have[rest] and rest != a:
                out_l.append(np.array([[a, rest, 0]]))
                out_t.append(np.array([[m, 1, 0]]))
            b = frequent[frequent < rest]
            if len(b):
                n = rest // b
                for k in (n, np.maximum(1, n - 1), np.maximum(1, n // 2)):
                    add(np.full_like(b, a), np.full_like(b, m), b, k, rest - k * b)
    if not out_l:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    both = np.unique(np.concatenate([np.concatenate(out_l), np.concatenate(out_t)], 1), axis=0)
    return both[:, :3], both[:, 3:]


def fit(lengths: np.ndarray, times: np.ndarray, hist: np.ndarray, capacity: int = CAPACITY, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients on the sparse pattern matrix."""
    size = len(hist)
    weight = np.where(np.arange(size) <= capacity // 8, SHORT_WEIGHT, 1.0)
    t = times.astype(float)

    def forward(x):
        return sum(np.bincount(lengths[:, k], weights=t[:, k] * x, minlength=size) for k in range(3))

    def back(r):
        return sum(r[lengths[:, k]] * t[:, k] for k in range(3))

    target = hist.astype(float)
    step, v = 1.0, np.ones(len(lengths))
    for _ in range(20):  # the greatest eigenvalue, by powers
        v = back(weight * forward(v))
        step = np.linalg.norm(v)
        v /= step or 1.0
    x = np.zeros(len(lengths))
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(weight * (forward(y) - target)) / step)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Containers for a histogram of lengths 1..capacity (``hist[0]`` is ignored)."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    counts, lens, tims = [], [], []

    def use(ls, ts, k):
        counts.append(int(k))
        lens.append(np.array(ls))
        tims.append(np.array(ts))
        left[ls] -= ts * k

    if left.any():
        lengths, times = enumerate_patterns(left, capacity)
        if len(lengths):
            x = fit(lengths, times, left, capacity)
            for p in np.argsort(-x, kind="stable"):
                k = int(np.floor(x[p] + 1e-9))
                if k < 1:
                    break
                ls, ts = lengths[p][times[p] > 0], times[p][times[p] > 0]
                k = min(k, int((left[ls] // ts).min()))
                if k > 0:
                    use(ls, ts, k)
    while left.any():  # residuals: the longest item first, then whatever fits best; used as often as it can be
        room, ls, ts = capacity, [], []
        here = left.copy()
        size = int(np.flatnonzero(here)[-1])
        while size:
            n = min(room // size, int(here[size]))
            if ls and n > 1:  # leave room for a better end than many equal items
                n = max(1, n - 1)
            ls.append(size)
            ts.append(n)
            room -= n * size
            here[size] = 0
            fits = np.flatnonzero(here[: room + 1])
            size = int(fits[-1]) if len(fits) and room else 0
        ls, ts = np.array(ls), np.array(ts)
        use(ls, ts, max(1, int((left[ls] // ts).min())))
    return Plan(np.array(counts, np.int64), lens, tims)


def segments(p: Plan) -> dict[str, np.ndarray]:
    """Where the items of each length go: rows sorted by (length, rank of the segment's first item)."""
    rows, start = [], 0
    for k, ls, ts in zip(p.counts, p.lengths, p.times, strict=True):
        offset = position = 0
        for size, n in zip(ls, ts, strict=True):
            rows.append((size, start, k, n, position, offset))
            offset += int(size * n)
            position += int(n)
        start += int(k)
    a = np.array(rows, np.int64).reshape(-1, 6)
    a = a[np.argsort(a[:, 0], kind="stable")]
    taken = a[:, 2] * a[:, 3]
    cum = np.concatenate(([0], np.cumsum(taken)))[:-1]
    new = np.concatenate(([True], a[1:, 0] != a[:-1, 0])) if len(a) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(new, cum, 0)) if len(a) else cum
    return {"length": a[:, 0], "first": cum - base, "start": a[:, 1], "times": a[:, 3], "position": a[:, 4], "offset": a[:, 5]}


def place(seg: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, position, offset) of items by their length and their rank (from 0) among items of that length."""
    scale = int(max(seg["first"].max(initial=0), rank.max(initial=0))) + 1
    i = np.searchsorted(seg["length"] * scale + seg["first"], length * scale + rank, side="right") - 1
    at = rank - seg["first"][i]
    nth = at % seg["times"][i]
    return seg["start"][i] + at // seg["times"][i], seg["position"][i] + nth, seg["offset"][i] + nth * length


def ranked(items: DataFrame, by: str, key: list[str], buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Add ``rank`` from 0 among equal ``by``: ranks inside hashed buckets plus the buckets' offsets, so no value is one task's work."""
    bucketed = items.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*key)) - 1)
    sizes = bucketed.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [by, "_bucket"]).withColumn("rank", F.col("_local") + F.col("_off")).drop("_bucket", "_local", "_off")


PLACED = "doc_id long, piece int, n_tokens long, container_id long, position int, start_token long"


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id, position, start_token) from (doc_id, n_tokens).

    An item longer than a container is split into full pieces, each a container
    of its own, and a last piece that is packed like any item.  Items of no
    length (null and empty texts) follow the others' containers in turn; where
    there are no other items they all go into container 0.
    """
    counts = durable(counts)
    full = F.when(F.col("n_tokens") > capacity, F.floor((F.col("n_tokens") - 1) / capacity)).otherwise(0).cast("int")
    cut = counts.withColumn("_full", full)
    wholes = cut.where("_full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("piece"))
    items = cut.select("doc_id", F.col("_full").alias("piece"), (F.col("n_tokens") - F.col("_full") * capacity).alias("n_tokens"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("n_tokens").count().collect():  # at most capacity + 1 rows
        hist[r[0]] = r[1]
    pieces = int(hist.sum()) + int(wholes.count())
    buckets = max(LEAST_BUCKETS, -(-pieces // BUCKET_ROWS))
    p = plan(hist, capacity)
    seg, packed = segments(p), p.containers
    # containers of patterns first, then the full pieces
    whole_rows = ranked(wholes.withColumn("_w", F.lit(0)), "_w", ["doc_id", "piece"], buckets).select(
        "doc_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), (F.col("rank") + packed).cast("long").alias("container_id"), F.lit(0).alias("position"), F.lit(0).cast("long").alias("start_token")
    )
    sizes = np.array([int(t.sum()) for t in p.times], np.int64)
    ends = np.cumsum(p.counts)
    fills = np.array([int((ls * ts).sum()) for ls, ts in zip(p.lengths, p.times, strict=True)], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, n, rank = (b.column(k) for k in range(4))
            n_, r = n.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
            box, pos, off = np.zeros_like(n_), np.zeros_like(n_), np.zeros_like(n_)
            some = n_ > 0
            if some.any():
                box[some], pos[some], off[some] = place(seg, n_[some], r[some])
            if (~some).any():
                e = r[~some]
                if packed:
                    which = np.searchsorted(ends, e % packed, side="right")
                    box[~some], pos[~some], off[~some] = e % packed, sizes[which] + e // packed, fills[which]
                else:
                    pos[~some] = e
            yield pa.RecordBatch.from_arrays(
                [doc, piece, n, pa.array(box), pa.array(pos.astype(np.int32)), pa.array(off)], names=["doc_id", "piece", "n_tokens", "container_id", "position", "start_token"]
            )

    rest = ranked(items, "n_tokens", ["doc_id", "piece"], buckets).select("doc_id", "piece", "n_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(work, PLACED)
    return rest.unionByName(whole_rows)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the least number possible by volume, tokens, share of unused space, fullest container."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return per.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count("*") * capacity)).alias("unused_share"),
    )
