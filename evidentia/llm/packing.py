"""Filling fixed-capacity containers with items.

Method: Karmarkar-Karp differencing for many ways. Every item starts as a partial partition into k
windows of which one is filled; the two partial partitions with the largest imbalance are merged
with opposing order, fullest window onto emptiest, until one is left, which has nearly equal
windows. Since they are never quite equal, windows above the capacity are mended: what is too much
moves to windows with room. The number of windows k starts at the least possible and rises whenever
the capacity is still exceeded. Items are dealt by hash into batches of bounded expected size.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.tokens import encode_documents
from evidentia.session import cut
from evidentia.sources.tables import load

CAPACITY = 2_048
#: Items of one batch, on average; larger batches waste less room, at most one window per batch.
BATCH = 1_024
#: Tasks that pack batches, at most; further batches share them.
_TASKS = 20_000


#: Exchanges are looked for in so many windows, from the emptiest on, or so many items.
_TRIED = 64


def _merge(a: list, b: list, windows: int, ticket: Iterator[int]) -> list:
    """Windows of two partial partitions merged in opposing order. Both hold only their filled
    windows as (sum, ticket, tree of items), emptiest first."""
    if len(a) < len(b):
        a, b = b, a
    overlap = len(a) + len(b) - windows
    if overlap > 0:  # the fullest of b take empty windows, the rest goes onto the emptiest of a
        doubled = [(x[0] + y[0], next(ticket), (x[2], y[2])) for x, y in zip(a[:overlap], reversed(b[:overlap]), strict=True)]
        added, a[:overlap] = doubled + b[overlap:], []
    else:
        added = b
    if len(added) * 16 < len(a):
        for window in added:
            bisect.insort(a, window)
    else:
        a += added
        a.sort()
    return a


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Near-equal partition of the items (by index) into ``windows`` by multiway differencing."""
    ticket = itertools.count()
    heap = [(-size if windows > 1 else 0, next(ticket), [(size, -1 - index, index)]) for index, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0]))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        merged = _merge(a, heap[0][2], windows, ticket)
        least = merged[0][0] if len(merged) == windows else 0
        heapq.heapreplace(heap, (least - merged[-1][0], next(ticket), merged))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                items.append(node)
        out.append(sorted(items))
    return out


def _swap(parts: list[list[int]], loads: list[int], sums: list[int], capacity: int) -> None:
    """Exchanges items of over-full windows for smaller ones of windows with room, in place, each
    time the pair that relieves the window most without filling the other above the capacity."""
    below = sorted((loads[k], k, w) for w, part in enumerate(parts) if sums[w] < capacity for k in part)
    for w in sorted((w for w, total in enumerate(sums) if total > capacity), key=lambda w: (-sums[w], w)):
        while (excess := sums[w] - capacity) > 0:
            best = (0, 0, -1, -1, -1)  # what the window is relieved of (up to the excess), what is left of the other's room
            for aim in (excess, excess * 3 // 4, excess // 2, excess // 4, excess // 8):
                for x in parts[w]:
                    at = bisect.bisect_right(below, (loads[x] - aim, len(loads), 0)) - 1
                    for size, y, v in below[max(0, at - _TRIED) : at + 1]:
                        less = loads[x] - size
                        if 0 < less <= capacity - sums[v] and (key := (min(less, excess), -less)) > best[:2]:
                            best = (*key, x, y, v)
                if best[2] >= 0:
                    break
            _, _, x, y, v = best
            if x < 0:
                break
            less = loads[x] - loads[y]
            below.pop(bisect.bisect_left(below, (loads[y], y, v)))
            parts[w].remove(x)
            parts[v].remove(y)
            parts[w].append(y)
            parts[v].append(x)
            sums[w] -= less
            sums[v] += less
            bisect.insort(below, (loads[x], x, v))


def mend(parts: list[list[int]], loads: list[int], capacity: int) -> list[int]:
    """Relieves over-full windows, in place; returns the items for which there is no room.

    First items are exchanged for smaller ones of windows with room. What is over-full still gives
    up the smallest item that is enough, or its largest ones. These look for the fullest window that
    has room, largest first; if none has, room is gathered in the emptiest one, by exchanging its
    items for smaller ones of other windows.
    """
    sums = [sum(loads[k] for k in part) for part in parts]
    _swap(parts, loads, sums, capacity)
    homeless: list[int] = []
    for w, part in enumerate(parts):
        while (excess := sums[w] - capacity) > 0:
            enough = [k for k in part if loads[k] >= excess]
            out = min(enough, key=lambda k: (loads[k], k)) if enough else max(part, key=lambda k: (loads[k], -k))
            part.remove(out)
            sums[w] -= loads[out]
            homeless.append(out)
    rooms = sorted((capacity - total, w) for w, total in enumerate(sums))

    def settle(item: int, w: int, at: int) -> None:
        rooms.pop(at)
        parts[w].append(item)
        sums[w] += loads[item]
        bisect.insort(rooms, (capacity - sums[w], w))

    def exchange(v: int, y: int, u: int, z: int) -> None:
        for w, out, into in ((v, y, z), (u, z, y)):
            rooms.pop(bisect.bisect_left(rooms, (capacity - sums[w], w)))
            parts[w].remove(out)
            parts[w].append(into)
            sums[w] += loads[into] - loads[out]
            bisect.insort(rooms, (capacity - sums[w], w))

    def make_room(item: int) -> bool:
        if sum(room for room, _ in rooms) < loads[item]:
            return False
        return any(gather(item, v) for _, v in rooms[: -_TRIED - 1 : -1])

    def gather(item: int, v: int) -> bool:
        while (lack := loads[item] - (capacity - sums[v])) > 0:
            best = (0, 0, -1, -1, -1)
            for room, u in rooms[: -_TRIED - 1 : -1]:
                if u != v and min(room, lack) > best[0]:
                    for y in parts[v]:
                        for z in parts[u]:
                            won = loads[y] - loads[z]
                            if 0 < won <= room and (key := (min(won, lack), -won)) > best[:2]:
                                best = (*key, y, u, z)
            _, _, y, u, z = best
            if y < 0:
                return False
            exchange(v, y, u, z)
        settle(item, v, bisect.bisect_left(rooms, (capacity - sums[v], v)))
        return True

    left = []
    for item in sorted(homeless, key=lambda k: (-loads[k], k)):
        at = bisect.bisect_left(rooms, (loads[item], -1))
        if at < len(rooms):
            settle(item, rooms[at][1], at)
        elif not make_room(item):
            left.append(item)
    return left


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Window number of every item; no window holds more than ``capacity``. Items above the
    capacity must be split before. Items of size 0 go to the first window."""
    if any(size > capacity for size in sizes):
        raise ValueError("an item exceeds the capacity")
    real = [k for k, size in enumerate(sizes) if size > 0]
    answer = [0] * len(sizes)
    if not real:
        return answer
    loads = [sizes[k] for k in real]
    windows = max(1, -(-sum(loads) // capacity), sum(2 * size > capacity for size in loads))
    while True:
        parts = difference(loads, windows)
        left = mend(parts, loads, capacity)
        if not left:
            break
        windows = min(len(loads), windows + max(1, -(-sum(loads[k] for k in left) // capacity)))
    for number, part in enumerate(parts):
        for k in part:
            answer[real[k]] = number
    return answer


def pack_documents(lengths: DataFrame, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Containers of ``doc_id, tokens``: one row per piece of a document, ``doc_id, piece_no,
    token_start, token_end, container_id``.

    Only a document above the capacity is split: its full pieces are containers of their own and
    the rest is packed like any other item. A document without tokens is one empty piece; null
    lengths count as 0. Every piece is in exactly one container.
    """
    items = lengths.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("int").alias("tokens"))
    full = F.floor(F.col("tokens") / capacity).cast("int")
    whole = items.where(F.col("tokens") >= capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")
    ).select(
        "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), ((F.col("piece_no") + 1) * capacity).alias("token_end"),
        F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("container_id"),
    )
    rest = items.where((F.col("tokens") % capacity > 0) | (F.col("tokens") == 0)).select(
        "doc_id", full.alias("piece_no"), (full * capacity).alias("token_start"), F.col("tokens").alias("token_end")
    )
    # rows that are repeated are told apart by a number, so that they are dealt to all batches too
    key = ["doc_id", "piece_no", "token_start", "token_end"]
    rest = cut(rest.groupBy(*key).agg(F.count("*").alias("copies")))
    batches = max(1, -(-(rest.agg(F.sum("copies")).first()[0] or 0) // batch))
    rest = rest.select(*key, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rest = rest.withColumn("batch", F.pmod(F.xxhash64("doc_id", "token_end", "copy"), F.lit(batches)).cast("int"))
    rest = rest.drop("copy").repartition(min(batches, _TASKS), "batch")  # by number, as the few bytes of a batch are much work

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "token_end"], kind="stable", ignore_index=True)
        numbers = pack((frame.token_end - frame.token_start).tolist(), capacity)
        frame["container_id"] = [f"{key[0]}-{number}" for number in numbers]
        return frame[["doc_id", "piece_no", "token_start", "token_end", "container_id"]]

    out = "doc_id bigint, piece_no int, token_start int, token_end int, container_id string"
    return whole.unionByName(rest.groupBy("batch").applyInPandas(fill, out))


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``documents, pieces, tokens, containers, fullest, lower_bound, unused``: what
    :func:`pack_documents` made, beside the least number of containers that could hold the tokens
    and the share of room left unused. Containers without tokens count as well."""
    size = F.col("token_end") - F.col("token_start")
    filled = containers.groupBy("container_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("piece_no") == 0).alias("documents"), F.sum(size).alias("tokens"))
    sums = filled.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    room = F.col("containers") * capacity
    return sums.withColumn("lower_bound", F.ceil(F.col("tokens") / capacity)).withColumn("unused", F.when(room > 0, F.round(1 - F.col("tokens") / room, 6)).otherwise(0.0))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of 2,048 tokens of byte_bpe_50k for all documents."""
    return pack_documents(cut(encode_documents(load(spark, folder, "documents"), counts=True)))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p9_containers(spark, folder))


QUERIES = {"p9_containers": p9_containers, "p9_report": p9_report}
ORACLE: dict[str, str] = {}
