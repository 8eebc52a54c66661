"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Pieces are placed longest first, each into the open bin, of whatever capacity, with the least room that holds it. If
none does, a bin is opened in the size that costs least for what it can be expected to hold: each permitted size is
filled, on trial, with the longest pieces still to come, and the size with the least cost a token wins. In the end each
bin is cut down to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that one task packs at a time; enough for hardly any waste.
SHARD = 50_000


def step_cost(capacity: int) -> float:
    """What a sequence costs: its tokens, attention's share that grows with the square, and a fixed part."""
    return capacity + capacity * capacity / 32768 + 16


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = step_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, the bin's final capacity) of each length; lengths are from 1 to the largest capacity.

    Pieces of one length are placed in the order given, so that equal inputs give equal bins.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    kinds = sorted(set(lengths.tolist()))  # lengths that still are to come
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def trial(capacity: int) -> int:
        """How much of a capacity the longest pieces to come would fill."""
        room, i = capacity, len(kinds)
        while room and (i := min(i, bisect_right(kinds, room))):
            x = kinds[i - 1]
            room -= min(left[x], room // x) * x
            i -= 1  # what is left of this length doesn't fit any more
        return capacity - room

    def put(number: int, room: int) -> None:
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(number)

    for k in order.tolist():
        x = int(lengths[k])
        at = bisect_left(rooms, x)
        if at < len(rooms):
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            fits = [c for c in sizes if c >= x]
            filled = {c: max(x, trial(c)) for c in fits}
            # what is not filled can be cut off in the end, down to the next permitted size
            room = min(fits, key=lambda c: (cost(next(s for s in sizes if s >= filled[c])) / filled[c], c))
            number = len(used)
            used.append(0)
        bins[k], offsets[k] = number, used[number]
        used[number] += x
        put(number, room - x)
        left[x] -= 1
        if not left[x]:
            kinds.pop(bisect_left(kinds, x))
    final = np.array([next(s for s in sizes if s >= u) for u in used], np.int64)
    return bins, offsets, final[bins] if len(bins) else bins


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text_hash, copy, piece, start, length): whole texts in words, cut where they are longer than `longest`. Equal rows
    are counted and numbered, so that no piece is known by where its row lies."""
    n = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), n.alias("n"))
    copies = sized.groupBy("doc_id", "text_hash", "n").agg(F.count("*").alias("copies"))
    numbered = copies.select("doc_id", "text_hash", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    cut = numbered.select("doc_id", "text_hash", "copy", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}")).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select("doc_id", "text_hash", "copy", "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - start).alias("length"))


PACKED = "doc_id long, piece int, start long, length long, bin_id string, offset long, capacity long"


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = step_cost, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, offset, capacity): where each piece of each whole text stands.

    Lengths are in words. Pieces are dealt to shards of about `shard` pieces by a hash of id, text, copy and piece, so that
    repeated rows spread too, and packed there; only their lengths are shuffled. The result is the same however the rows are
    laid out in files and partitions. A text without words, or null, has one piece of
    length 0 in no bin. Repeated rows are packed each for itself. Other columns of docs are not read.
    """
    longest = max(capacities)
    cut = stored(pieces(docs, longest), "pieces")
    full = cut.where("length > 0")
    shards = max(1, -(-full.count() // shard))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "text_hash", "copy"], kind="stable")
        bins, offsets, final = pack(group["length"].to_numpy(np.int64), capacities, cost)
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64"), "piece": group["piece"], "start": group["start"], "length": group["length"], "bin_id": group["shard"].astype(str) + "-" + pd.Series(bins, index=group.index).astype(str), "offset": offsets, "capacity": final})

    packed = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(run, PACKED)
    none = cut.where("length <= 0").select("doc_id", "piece", "start", F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("capacity"))
    return packed.unionByName(none)
