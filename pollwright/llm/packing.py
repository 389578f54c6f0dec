"""Packing of token sequences into windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import per_process, slices
from pollwright.llm.word_bpe import DEFAULT_PATH, ChunkIds

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Item numbers dealt into ``ways`` parts of nearly equal sums.

    Every partial partition lists its non-empty parts by falling sum. The two with the largest
    imbalance are merged, the large parts of one onto the small parts of the other, until one
    is left.
    """
    heap = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        # While a partial partition has empty parts, its imbalance is its largest sum, so it
        # stays on top and takes in the next largest; single items come in falling order.
        grown = False
        while heap and len(sums) < ways and len(heap[0][2]) == 1:
            _, _, more, others = heapq.heappop(heap)
            sums, parts = sums + more, parts + others
            grown = True
        if heap and not (grown and len(sums) == ways):
            _, _, more, others = heapq.heappop(heap)
            both = max(0, len(sums) + len(more) - ways)
            # The smallest parts here meet the largest over there.
            kept = len(sums) - both
            met = [a + b for a, b in zip(sums[kept:], reversed(more[:both]))]
            met_parts = [a + b for a, b in zip(parts[kept:], reversed(others[:both]))]
            sums, parts = sums[:kept] + met + more[both:], parts[:kept] + met_parts + others[both:]
        by = sorted(range(len(sums)), key=lambda i: -sums[i])
        # Only differences count from here on; the parts themselves keep the items.
        least = sums[by[-1]] if len(sums) == ways else 0
        sums, parts = [sums[i] - least for i in by], [parts[i] for i in by]
        heapq.heappush(heap, (-sums[0], order, sums, parts))
        order += 1
    return heap[0][3] if heap else []


def pack(lengths: list[int], capacity: int, chunk: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces.

    Full windows are cut off each document first. What is left is cut at multiples of
    ``chunk`` and dealt into the fewest windows that can hold it; while any is above the
    capacity, one more window is tried.
    """
    windows, items = [], []
    for doc, length in enumerate(lengths):
        full = length - length % capacity
        windows += [[(doc, start, capacity)] for start in range(0, full, capacity)]
        items += [(doc, start, min(chunk, length - start)) for start in range(full, length, chunk)]
    sizes = [size for *_, size in items]
    ways = -(-sum(sizes) // capacity)
    while items:
        parts = differencing(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return windows + [joined([items[i] for i in sorted(part)]) for part in parts if part]
        ways += 1
    return windows


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring pieces of one document as one piece."""
    out: list[tuple[int, int, int]] = []
    for doc, start, length in pieces:
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + length)
        else:
            out.append((doc, start, length))
    return out


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    end_id: int = 2,
    group_windows: int = 256,
    chunk: int = 512,
    path: str = DEFAULT_PATH,
) -> DataFrame:
    """Every document's ids, ended by ``end_id``, as pieces of windows of at most ``capacity``.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Each task
    reads its documents in groups of about ``group_windows`` windows and packs group after
    group, so memory is bounded and nothing is shuffled; only a task's last group can be small.
    A window's number is the task's partition number and a counter, so a task that is run again
    gives the same rows.

    Null text is empty and gives the single ``end_id``. Null ids and repeated rows are packed
    like others, each row for itself; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_process(("ids", path), lambda: ChunkIds(path))
        first = TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        waiting: list[tuple[int | None, bytes]] = []
        tokens = done = 0

        def packed() -> pa.RecordBatch:
            nonlocal done
            rows = []
            for window in pack([len(ids) // 4 for _, ids in waiting], capacity, chunk):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids = waiting[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, len(ids) // 4, first + done, offset))
                    offset += length
                done += 1
            names = SCHEMA.replace(" bigint", "").split(", ")
            return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})

        for part in slices(batches, 1536):
            for doc_id, ids in zip(part.column(0).to_pylist(), ids_of.encode(part.column(1))):
                waiting.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= group_windows * capacity:
                    yield packed()
                    waiting, tokens = [], 0
            # Arrow holds on to what a slice took, beside what Python and the executor's JVM hold.
            pa.default_memory_pool().release_unused()
        if waiting:
            yield packed()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
