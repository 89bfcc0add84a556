"""Contiguous minimax sharding of documents, in DataFrame operations only.

Rows with equal texts form one atomic group. Groups stand in a fixed order, and a
binary search finds the smallest capacity for which a greedy cut of that order
needs no more than the wanted number of shards; then the order is cut there.

The order is by a 64-bit hash of the text, so a shard of small groups is a range of
hash values. Groups of at least 1/256 of a fair share (at most 256 for each shard,
whatever the input) are dealt to lanes beforehand and stand at the head of their
lane, so that cuts fall between small groups. A group of a fair share or more gets a
shard of its own, and the search divides what is left among the other shards.

The driver never sees all groups: it holds byte sums of hash ranges ("cells"). The
greedy walk may at first cut inside a cell of several groups; such cells, and those
just before them, are split 256 ways by one grouped sum over the group table, until
every cut falls on a group. The result is that of the search over all groups.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, col

TOP_BITS, STEP_BITS = 14, 8
BIG = 256  # groups of at least 1/BIG of a fair share are placed one by one


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text",
                    extra_bytes: int = 8) -> DataFrame:
    """Each row's shard under the ``bytes`` law.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this
    law). Size is the UTF-8 length plus ``extra_bytes``. A null text has no bytes, crc
    0, and is grouped with empty texts. Repeated rows each count and get slots of their
    own. An empty table gives an empty result. Other columns are ignored. With fewer
    groups than shards some shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(extra_bytes)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"))
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(rows)
    groups = scratch.keep(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    if not total:
        cut: list[int] = []
        big: dict[int, int] = {}
    else:
        cut, big = _plan(groups, total, shards)

    number = reduce(lambda a, b: a + b, [(F.col("h") >= F.lit(c)).cast("int") for c in cut], F.lit(0))
    placed = rows.withColumn("shard", number.cast("int"))
    if big:
        table = F.broadcast(spark.createDataFrame(sorted(big.items()), "h long, own int"))  # at most BIG * shards rows
        placed = placed.join(table, "h", "left").withColumn("shard", F.coalesce("own", "shard"))

    # Slots: rows of a shard are dealt to parts by a hash of the id, numbered inside a
    # part, and moved on by the sizes of the parts before it. About 50,000 rows a part.
    parts = max(1, -(-(n_rows or 0) // (shards * 50_000)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "h", "text_crc32")
    return (placed.withColumn("r", F.row_number().over(within))
            .join(sizes, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("r") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def _plan(groups: DataFrame, total: int, shards: int) -> tuple[list[int], dict[int, int]]:
    """Hash values at which shards 1.. begin for small groups, and the shard of each big group."""
    least = max(1, -(-total // shards) // BIG)
    big = sorted(((r.bytes, r.h) for r in groups.where(F.col("bytes") >= least).collect()), reverse=True)  # at most BIG * shards
    small = groups.where(F.col("bytes") < least)
    alone = {}  # a group of a fair share or more has a shard of its own; the others share the rest
    while shards > 1 and big and big[0][0] * shards >= total:
        size, h = big.pop(0)
        shards -= 1
        total -= size
        alone[h] = shards
    lanes = _lanes(big, shards)
    cells = [(r.lo << (64 - TOP_BITS), 64 - TOP_BITS, r.bytes, r.n) for r in
             small.groupBy(F.shiftright("h", 64 - TOP_BITS).alias("lo"))
             .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()]
    cells.sort()
    heads = _heads(lanes, cells, shards)
    while True:
        seq = _sequence(cells, heads)
        if not seq:
            return [], alone
        capacity, cuts = _smallest(seq, shards)
        loose = _inside(seq, cuts)
        if not loose:
            cut, placed = _read_off(seq, cuts)
            return cut, placed | alone
        wanted = sorted({i for at, k in loose for i in range(max(0, at - k), at + 1)
                         if seq[i][0] is not None and seq[i][3] > 1})
        split = {seq[i][0]: seq[i][1] for i in wanted}
        ranges = [(lo, lo + (1 << bits) - 1, bits) for lo, bits in split.items()]
        merged = _merge(ranges)
        cells = [c for c in cells if c[0] not in split]
        for bits in sorted({b for _, _, b in ranges}):
            step = max(0, bits - STEP_BITS)
            hit = reduce(lambda a, b: a | b, [F.col("h").between(lo, hi) for lo, hi, b in merged if b == bits])
            cells += [(r.lo << step, step, r.bytes, r.n) for r in
                      small.where(hit).groupBy(F.shiftright("h", step).alias("lo"))
                      .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()]
        cells.sort()


def _merge(ranges):
    """Touching ranges of one width as one."""
    out = []
    for lo, hi, bits in sorted(ranges):
        if out and out[-1][2] == bits and out[-1][1] + 1 == lo:
            out[-1] = (out[-1][0], hi, bits)
        else:
            out.append((lo, hi, bits))
    return out


def _lanes(big, shards):
    """Deal big groups, largest first, each to the emptiest lane."""
    heap = [(0, k) for k in range(shards)]
    lanes = [[] for _ in range(shards)]
    for size, h in big:
        load, k = heapq.heappop(heap)
        lanes[k].append((h, size))
        heapq.heappush(heap, (load + size, k))
    return sorted(lanes, key=lambda x: -sum(s for _, s in x))


def _heads(lanes, cells, shards):
    """Before which cell each lane's big groups stand: small groups level the lanes."""
    loads = [sum(s for _, s in lane) for lane in lanes]
    rest = sum(c[2] for c in cells)
    low = sorted(loads)
    level, used = low[0], 0
    for i in range(shards):  # water level over the i + 1 emptiest lanes
        level = (rest + sum(low[:i + 1])) / (i + 1)
        if i + 1 == shards or level <= low[i + 1]:
            break
    at, want, taken, heads = 0, 0.0, 0, []
    for load, lane in zip(loads, lanes):
        while at < len(cells) and taken + cells[at][2] / 2 < want:
            taken += cells[at][2]
            at += 1
        heads.append((cells[at][0] if at < len(cells) else 1 << 63, lane))
        want += max(0.0, level - load)
    return heads


def _sequence(cells, heads):
    """The order as (lowest hash or None, bits, bytes, groups, big group's hash)."""
    seq, k = [], 0
    for c in cells:
        while k < len(heads) and heads[k][0] <= c[0]:
            seq += [(None, 0, size, 1, h) for h, size in heads[k][1]]
            k += 1
        seq.append((*c, None))
    for _, lane in heads[k:]:
        seq += [(None, 0, size, 1, h) for h, size in lane]
    return seq


def _walk(ends, atomic, capacity, shards):
    """Greedy cuts as byte places; a cut inside a cell of several groups is taken as it falls."""
    place, cuts, total = 0, [], ends[-1]
    while place < total and len(cuts) < shards:
        reach = place + capacity
        if reach >= total:
            return cuts, True
        i = bisect_right(ends, reach)  # first cell that ends beyond reach
        start = ends[i - 1] if i else 0
        nxt = start if atomic[i] else reach
        if nxt <= place:
            return cuts, False
        cuts.append(nxt)
        place = nxt
    return cuts, place >= total and len(cuts) < shards


def _smallest(seq, shards):
    """Smallest capacity that the greedy walk finds feasible, and its cuts."""
    ends, atomic, run = [], [], 0
    for _, _, size, n, _ in seq:
        run += size
        ends.append(run)
        atomic.append(n == 1)
    lo = max(-(-run // shards), max((s[2] for s in seq if s[3] == 1), default=1))
    hi = run
    while lo < hi:
        mid = (lo + hi) // 2
        if _walk(ends, atomic, mid, shards)[1]:
            hi = mid
        else:
            lo = mid + 1
    return lo, _walk(ends, atomic, lo, shards)[0]


def _inside(seq, cuts):
    """Cells of several groups that a cut falls into, with the cut's number."""
    ends, run = [], 0
    for s in seq:
        run += s[2]
        ends.append(run)
    out = []
    for k, c in enumerate(cuts, 1):
        i = bisect_left(ends, c)
        if ends[i] != c:
            out.append((i, k))
    return out


def _read_off(seq, cuts):
    """Turn byte places into hash values (small groups) and shard numbers (big groups)."""
    bounds, big, run, shard, pending = [], {}, 0, 0, 0
    for lo, _, size, _, h in seq:
        while shard < len(cuts) and run >= cuts[shard]:
            shard += 1
            pending += 1
        if lo is None:
            big[h] = shard
        else:
            bounds += [lo] * pending
            pending = 0
        run += size
    return bounds, big
