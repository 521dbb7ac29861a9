"""Items of varying length into containers of fixed capacity.

Method: bounded-space online packing.  Each partition streams its items past a
fixed number of open windows.  An item goes where it leaves the least room; if it
fits nowhere, the fullest window is emitted and a new one opened.  The items of the
windows that are open at a partition's end are packed again, the largest first, in
ever fewer partitions, each over the leftovers of a fixed number of others.  Only an item larger than the capacity is
split: into full windows and one rest.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.common import cut

#: Containers' capacity in tokens, open windows of a partition, partitions merged into one.
CAPACITY, WINDOWS, FAN_IN = 2048, 64, 32

#: Leftover windows filled to this part are not packed again.
FULL = 0.99

_PLACED = "container_id string, is_open boolean, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


class Windows:
    """Open windows by free room; `put` returns the windows it had to emit."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> list[tuple[int, int, list]]:
        """Place an item of `size` <= capacity; emitted windows as (window, fill, items)."""
        emitted = []
        at = bisect.bisect_left(self.rooms, (size, -1))
        if at == len(self.rooms):
            if len(self.rooms) == self.most:
                room, w = self.rooms.pop(0)
                emitted.append((w, self.capacity - room, self.items.pop(w)))
            room, w = self.capacity, self.next
            self.next += 1
            self.items[w] = []
        else:
            room, w = self.rooms.pop(at)
        self.items[w].append(item)
        if room == size:
            emitted.append((w, self.capacity, self.items.pop(w)))
        else:
            bisect.insort(self.rooms, (room - size, w))
        return emitted

    def rest(self) -> list[tuple[int, int, list]]:
        return [(w, self.capacity - room, self.items[w]) for room, w in self.rooms]


def _pack(capacity: int, windows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        open_ = Windows(capacity, windows)
        whole = 0

        def frame(done: list[tuple[str, bool, int, list]]) -> pd.DataFrame:
            return _frame([(cid, is_open, items) for cid, is_open, _, items in done])

        for batch in batches:
            done: list[tuple[str, bool, int, list]] = []
            for doc, size in zip(batch["doc_id"].tolist(), batch["n_tokens"].tolist()):
                start, piece, size = 0, 0, int(size)
                while size - start > capacity or (size - start == capacity and size):
                    done.append((f"{part}f{whole}", False, capacity, [(doc, piece, start, capacity)]))
                    whole, piece, start = whole + 1, piece + 1, start + capacity
                if start == size and piece:
                    continue
                for w, fill, items in open_.put(size - start, (doc, piece, start, size - start)):
                    done.append((f"{part}w{w}", False, fill, items))
            if done:
                yield frame(done)
        yield frame([(f"{part}w{w}", fill < FULL * capacity, fill, items) for w, fill, items in open_.rest()])

    return run


def _merge(capacity: int, windows: int, level: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        open_ = Windows(capacity, FAN_IN * windows)  # as many as the leftovers had

        def frame(done: list, is_open: bool) -> pd.DataFrame:
            return _frame([(f"m{level}-{part}w{w}", is_open and fill < FULL * capacity, items) for w, fill, items in done])

        for batch in batches:
            done = []
            for item in batch[["doc_id", "piece", "start_token", "n_tokens"]].itertuples(index=False):
                done += open_.put(int(item[3]), tuple(item))
            if done:
                yield frame(done, False)
        yield frame(open_.rest(), not last)

    return run


def _frame(done: list[tuple[str, bool, list]]) -> pd.DataFrame:
    rows = [(cid, is_open, *item) for cid, is_open, items in done for item in items]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLACED.split(", ")])


def pack(items: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens) of every piece of every item.

    `items`: ``doc_id``, ``n_tokens``.  Null sizes are no items; an item of size 0 lies in
    some container; an item larger than the capacity is split into full containers
    and a rest (``piece`` from 0, ``start_token`` in the item); repeated rows are
    packed each; no items give no containers.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")
    sized = items.where(F.col("n_tokens").isNotNull()).select("doc_id", F.col("n_tokens").cast("bigint"))
    placed = cut(sized.mapInPandas(_pack(capacity, windows), _PLACED))
    out = placed.where("NOT is_open")
    left, parts, level = placed.where("is_open"), max(1, placed.rdd.getNumPartitions()), 0
    while True:
        parts, level = -(-parts // FAN_IN), level + 1
        # At most `windows` windows from each partition of the level before: bounded, whatever the data.
        spread = left.repartition(parts, "doc_id", "piece").sortWithinPartitions(F.col("n_tokens").desc(), "doc_id", "piece")
        merged = cut(spread.mapInPandas(_merge(capacity, windows, level, parts == 1), _PLACED))
        out = out.unionByName(merged.where("NOT is_open"))
        if parts == 1:
            return out.select("container_id", "doc_id", "piece", "start_token", "n_tokens")
        left = merged.where("is_open")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each container with its fill."""
    return (
        packed.groupBy("container_id")
        .agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("fill_tokens"))
        .withColumns({"unused_tokens": F.lit(capacity) - F.col("fill_tokens"), "fill_rate": F.round(F.col("fill_tokens") / capacity, 6)})
    )
