"""Packing token ids into sequences of a fixed length by best-fit decreasing.

Documents longer than a window are first cut into full windows; the remainders of a task, longest first, each go into
the open window that they fit most tightly, which a segment tree indexed by remaining capacity finds.  A task packs
what it reads: no shuffle, deterministic when a task is run again, and memory of a few integers a document.  Full
windows leave at once; only the remainders wait for the end of the task.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed and returned as null; repeated rows
are packed each; a text of any length is cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import tokenization

WINDOW = 2048
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are (task << TASK_BITS) + number in the task.
TASK_BITS = 36


class CapacityTree:
    """Open windows by remaining capacity; ``take(need)`` pops one with the least capacity that is at least ``need``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)  # windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first right sibling that holds a window
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        sequence = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return sequence, capacity


def best_fit_decreasing(lengths: np.ndarray, window: int, first_sequence: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ties in length keep their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, following = CapacityTree(window), first_sequence
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = tree.take(need)
        if got is None:
            got, following = (following, window), following + 1
        sequence[i], offset[i] = got[0], window - got[1]
        if got[1] > need:
            tree.put(got[1] - need, got[0])
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, and with ``with_ids`` the piece's ids as array<int>."""
    C.tune(docs.sparkSession)
    path = path or tokenization.default_path()
    ddl = PIECES + ", ids array<int>" * with_ids
    schema = C.arrow_schema(ddl)
    end = end_id.to_bytes(4, "little")

    def table(rows: list[tuple], sequence, offset) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(x, pa.int64()) for x in (*cols[:5], sequence, offset)]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        task = TaskContext.get().partitionId() << TASK_BITS
        full, rest = 0, []
        for batch, data, off in C.chunks(batches):
            rows = []
            for doc_id, ids in zip(C.column(batch, "doc_id").to_pylist(), tokenization.encode_batch(path, data, off), strict=True):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    row = (doc_id, a, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else []))
                    (rows if row[2] == window else rest).append(row)
            if rows:
                yield table(rows, task + full + np.arange(len(rows)), np.zeros(len(rows), np.int64))
                full += len(rows)
        sequence, offset = best_fit_decreasing(np.array([x[2] for x in rest], np.int64), window, task + full)
        for a in range(0, len(rest), 2000):
            yield table(rest[a : a + 2000], sequence[a : a + 2000], offset[a : a + 2000])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl.replace(", ", ","))
