"""Problem 9: documents, sized in tokens, in containers of fixed capacity.

The packing never sees single documents.  Sizes are at most the capacity, so a histogram over sizes, bounded by the
capacity whatever the number of documents, states the whole instance.  Martello-Toth dominance fixes sets of sizes that
no other set can beat, many containers at a time; the rest is packed best-fit decreasing, again by whole groups of equal
containers.  Each group takes a stretch of the ranks of its sizes, and a document finds its container from its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import count_column, vocabulary
from leafmill.session import cut, table

#: Tokens a container holds.
CAPACITY = 2048


def reduce_dominated(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sets of sizes that dominate all alternatives, as (sizes with multiplicity, containers); takes them out of ``hist``.

    For each size s from the largest down, with r = capacity - s left beside it, over all sizes still there:
    nothing fits: s alone; some t = r exactly fills: s with t, for whatever else fits beside s fits in the place of t; only
    one more can fit: s with the largest t <= r; two can fit, but none of the pairs has more in it than the largest single
    t <= r, and no three can: s with t.  A size that none of this decides is passed over, as it stays among the alternatives
    of the smaller ones; what is fixed may decide it later, so the sizes are gone through until nothing more is fixed.
    """
    fixed: list[tuple[dict[int, int], int]] = []
    again = True
    while again:
        again = False
        sizes = [int(s) for s in np.flatnonzero(hist)]
        at = len(sizes) - 1
        while at >= 0:
            s = sizes[at]
            got = _dominating(hist, sizes, s, capacity) if hist[s] else None
            if got is None:
                at -= 1
                continue
            content, count = got
            fixed.append(got)
            for x, per in content.items():
                hist[x] -= per * count
            again = True
            at = min(at, len(sizes) - 1)
        again = again and bool(hist.any())
    return fixed


def _dominating(hist: np.ndarray, sizes: list[int], s: int, capacity: int) -> tuple[dict[int, int], int] | None:
    """The set that dominates all sets with an item of size s, and how often it can be taken; None where none is found."""
    n, r = int(hist[s]), capacity - s
    beside = lambda x: int(hist[x]) - (x == s)
    if r > 0 and r < len(hist) and beside(r) > 0:
        t = r
    else:
        k = bisect_left(sizes, r + 1) - 1
        while k >= 0 and beside(sizes[k]) <= 0:
            k -= 1
        if k < 0:
            return {s: 1}, n
        t = sizes[k]
        live = [x for x in sizes[: k + 1] if beside(x) > 0]
        low = live[0]
        second = low if beside(low) > 1 else live[1] if len(live) > 1 else capacity
        if low + second <= r:
            third = low if beside(low) > 2 else second if second != low and beside(second) > 1 else next((x for x in live if x > second), capacity)
            if low + second + third <= r or _best_pair(live, beside, r) > t:
                return None
    if t == s:
        return ({s: 2}, n // 2) if n > 1 else ({s: 1}, 1)
    return {s: 1, t: 1}, min(n, int(hist[t]))


def _best_pair(live: list[int], beside, r: int) -> int:
    """The largest sum of two items beside s that fits into r."""
    best, j = 0, len(live) - 1
    for i, a in enumerate(live):
        while j >= 0 and live[j] + a > r:
            j -= 1
        k = j
        if k == i and beside(a) < 2:
            k -= 1
        if k < 0:
            break
        best = max(best, a + live[k])
    return best


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over groups of equal containers; empties ``hist``."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []
    closed: list[tuple[dict[int, int], int]] = []
    smallest = int(np.flatnonzero(hist)[0]) if hist.any() else 0

    def put(content: dict[int, int], count: int, room: int) -> None:
        if room < smallest:
            closed.append((content, count))
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((content, count))

    for s in map(int, np.flatnonzero(hist)[::-1]):
        n = int(hist[s])
        hist[s] = 0
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                whole, rest = divmod(n, per)
                if whole:
                    put({s: per}, whole, capacity - per * s)
                if rest:
                    put({s: rest}, 1, capacity - rest * s)
                break
            room = rooms[i]
            content, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            per = room // s
            whole = min(count, n // per)
            n -= whole * per
            left = count - whole
            if whole:
                put(content | {s: per}, whole, room - per * s)
            if left and n:
                put(content | {s: n}, 1, room - n * s)
                left, n = left - 1, 0
            if left:
                put(content, left, room)
    return closed + [g for room in rooms for g in by_room[room]]


def plan(hist: np.ndarray, capacity: int) -> tuple[pd.DataFrame, int]:
    """Stretches (size, lo, per, first): the items of a size with ranks from lo on lie per in a container, from container first on."""
    rest = hist.astype(np.int64).copy()
    rest[0] = 0
    groups = reduce_dominated(rest, capacity)
    groups += best_fit(rest, capacity)
    given = np.zeros(len(hist), np.int64)
    rows, first = [], 0
    for content, count in groups:
        for s, per in content.items():
            rows.append((s, given[s], per, first))
            given[s] += per * count
        first += count
    assert (given[1:] == hist[1:]).all()
    return pd.DataFrame(rows, columns=["size", "lo", "per", "first"]), first


def items(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, part, size, start): a row per document, and one per piece of a document larger than the capacity."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity).cast("int"))
    got = sizes.select(key, F.col("size").alias("total"), F.posexplode(F.sequence(F.lit(1), pieces)).alias("part", "_one"))
    start = F.col("part").cast("long") * capacity
    return got.select(key, "part", F.least(F.lit(capacity).cast("long"), F.col("total") - start).alias("size"), start.alias("start"))


_RANKED = "part int, size long, start long, pos long, piece int"


def ranked(its: DataFrame, key: str) -> DataFrame:
    """``its`` with pos, the place of a row among those of its size in its piece of the order (size, key, part), and the piece.

    The rows are partitioned by range of that order, so a size that most of the documents have lies in many pieces.
    """
    parts = int(its.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", F.col(key).asc_nulls_first(), "part"]
    rows = its.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()).select(key, "part", "size", "start", "piece")

    def run(batches):
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(2).to_numpy()
            first = np.concatenate([[True], size[1:] != size[:-1]])
            place = np.arange(len(size))
            pos = place - np.maximum.accumulate(np.where(first, place, 0))
            if size[0] == last:
                pos[: int(np.argmax(size != last)) if (size != last).any() else len(size)] += seen
            last, seen = size[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(pos, pa.int64()), b.column(4)], names=[key, "part", "size", "start", "pos", "piece"])

    kind = its.schema[key].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"`{key}` {kind}, {_RANKED}"))


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, container_id, size, start) for every row of ``sizes`` (key, size).

    Rows of size 0 (null and empty documents) need no room and have the null container.  Rows that repeat a key are
    items of their own.  Null keys are packed like others.  The containers' contents in sizes are the same for any partitioning.
    """
    its = cut(items(sizes, key, capacity))
    rows = ranked(its.where("size > 0"), key)
    counts = rows.groupBy("piece", "size").agg(F.count("*").alias("n")).toPandas().sort_values(["size", "piece"])  # at most capacity + pieces rows
    c_size, c_piece, c_n = (counts[c].to_numpy(np.int64) for c in ("size", "piece", "n"))
    hist = np.bincount(c_size, c_n, capacity + 1).astype(np.int64) if len(c_size) else np.zeros(capacity + 1, np.int64)
    before = np.cumsum(c_n) - c_n - (np.cumsum(hist) - hist)[c_size] if len(c_size) else np.zeros(0, np.int64)
    stretches, _ = plan(hist, capacity)
    stretches = stretches.sort_values(["size", "lo"], kind="stable")
    s_size, s_lo, s_per, s_first = (stretches[c].to_numpy(np.int64) for c in ("size", "lo", "per", "first"))
    begin, end = np.searchsorted(s_size, np.arange(capacity + 1)), np.searchsorted(s_size, np.arange(capacity + 1), "right")
    wide = int(c_piece.max()) + 1 if len(c_piece) else 1
    shared = sizes.sparkSession.sparkContext.broadcast((s_lo, s_per, s_first, begin, end, c_size * wide + c_piece, before, wide))

    @F.pandas_udf("long")
    def container(size: pd.Series, piece: pd.Series, pos: pd.Series) -> pd.Series:
        lo, per, first, beg, fin, keys, off, wide = shared.value
        s, r = size.to_numpy(np.int64), pos.to_numpy(np.int64)
        r = r + off[np.searchsorted(keys, s * wide + piece.to_numpy(np.int64))]
        out = np.empty(len(s), np.int64)
        for x in np.unique(s):
            at = np.flatnonzero(s == x)
            k = beg[x] + np.searchsorted(lo[beg[x] : fin[x]], r[at], "right") - 1
            out[at] = first[k] + (r[at] - lo[k]) // per[k]
        return pd.Series(out)

    full = rows.select(key, "part", container("size", "piece", "pos").alias("container_id"), "size", "start")
    void = its.where("size <= 0").select(key, "part", F.lit(None).cast("long").alias("container_id"), "size", "start")
    return full.unionByName(void)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one larger than a container, with its container."""
    return pack(count_column(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary()))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the least number of containers that could hold them, and the share of space in use."""
    got = p9_containers(spark, sf_dir).where("container_id is not null")
    per = got.groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"),
        F.coalesce(F.ceil(F.sum("used") / CAPACITY), F.lit(0)).alias("least"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
