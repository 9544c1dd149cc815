"""Packing of token ids into windows of a fixed size by multiway number differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hearthpanel.llm.common import chunks
from hearthpanel.llm.tokens import encoder

WINDOW = 4096
#: Rest pieces that are balanced against each other; groups never leave their task.
GROUP = 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: Sequence[int], ways: int) -> list[list[int]]:
    """Split items into ``ways`` sets of near-equal total by Karmarkar-Karp differencing.

    A partial partition is a list of (total, items), largest first, without its
    empty sets. The two with the widest spread are merged so that large totals
    of one meet small ones of the other, until one partition is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        heapq.heappush(heap, (-size, i, [(size, [i])]))
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - ways  # sets that have to be merged
        if both <= 0:
            merged = a + b
        else:
            # b's largest sets meet a's empty or smallest ones.
            free = len(b) - both
            merged = a[: len(a) - both] + b[:free]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a[len(a) - both :]), b[free:])]
            if free < 0:
                raise AssertionError("a partial partition has more sets than ways")
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows(sizes: Sequence[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items in the fewest near-equal windows that differencing makes fit; the count rises while one is too full."""
    if not sizes:
        return []
    ways = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, ways)
        if max(sum(sizes[i] for i in items) for items in found) <= capacity:
            return found
        ways += 1


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Pieces of all documents of (doc_id, text), placed in windows of at most ``window`` ids.

    A document is cut into full windows, each a sequence of its own, and one
    rest; the rests of ``group`` consecutive documents of a task are balanced by
    differencing. No row moves between tasks, so no source or id can overload
    one, and a task that runs again packs the same rows alike.

    Null texts count as empty and give the end id alone; a null doc_id is kept;
    rows that repeat an id are packed each. An empty table gives no piece.
    Other columns are not read. Sequence ids are unique: the task's number in
    the upper half, a counter in the lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made = 0
        end = np.array([end_id], "<u4").tobytes()
        full: list[tuple] = []
        rests: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def balanced() -> list[tuple]:
            nonlocal made
            rows = []
            for items in windows([len(r[2]) // 4 for r in rests], window):
                offset = 0
                for i in items:
                    doc, start, ids, total = rests[i]
                    rows.append((doc, start, len(ids) // 4, ids, total, base + made, offset))
                    offset += len(ids) // 4
                made += 1
            rests.clear()
            return rows

        for piece in chunks(batches):
            rows = []
            for doc, ids in zip(piece.column("doc_id").to_pylist(), encoder(tokenizer).encode(piece.column("text"))):
                ids += end
                total = len(ids) // 4
                cut = total // window * window
                for start in range(0, cut, window):
                    full.append((doc, start, window, ids[4 * start : 4 * (start + window)], total, base + made, 0))
                    made += 1
                if total > cut:
                    rests.append((doc, cut, ids[4 * cut :], total))
                if len(rests) >= group:
                    rows += balanced()
            if rows := rows + full:
                yield batch(rows)
            full.clear()
        if rests:
            yield batch(balanced())

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
