"""Shared pieces of the training-data operators: scratch storage, batch reading and vectorised hashing.

Text columns arrive as Arrow batches.  Everything here works on the UTF-8 bytes of a *chunk*: a few MB of
consecutive documents of one batch, laid end to end in one ``uint8`` array with an offsets array, so that hashing
and window logic are NumPy operations over millions of positions and memory is bounded by ``CHUNK_BYTES`` (one
document longer than that makes a chunk of its own).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: A run of positions is one long: start << RUN_BITS | count.
RUN_BITS = 24
RUN_MASK = (1 << RUN_BITS) - 1
#: ASCII white space: \x20 and \x09-\x0D, which is also what ``bytes.split()`` splits at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for a written intermediate table, in the shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a folder of this machine; on a cluster other machines couldn't see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:/tmp/checkpoints"
    return f"{base.rstrip('/')}/parchment-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows, as one text may be as long as thousands of others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for a scan); used only to choose numbers of buckets."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 40


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """A power of two of hash buckets so that one holds about ``per_bucket`` bytes of input, 64 to 65536."""
    want = max(1, input_bytes(df) // per_bucket)
    return 1 << min(16, max(6, int(want).bit_length()))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as empty.  No copy unless there are nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most CHUNK_BYTES of text (or one document), with their bytes and offsets."""
    for batch in batches:
        data, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_arrow(df: DataFrame, fn: Callable, ddl: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` of ``fn(batch, bytes, offsets) -> iterable of {column: values}`` over chunks."""
    schema = arrow_schema(ddl)

    def run(batches):
        for batch, data, off in chunks(batches, text):
            for out in fn(batch, data, off):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k.type) for k, x in ((k, out[k.name]) for k in schema)], schema=schema)

    return df.mapInArrow(run, ddl.replace(", ", ","))


# --- hashing -------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919 + 17))


BASE = 0xD1342543DE82EF95  #: odd, so that it has an inverse modulo 2^64


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^k and BASE^-k modulo 2^64 for k < n; kept for ordinary chunks, made anew for one oversized document."""
    return _powers(CHUNK_BYTES + 1024) if n <= CHUNK_BYTES + 1024 else _powers.__wrapped__(n)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        table, have = np.ones(n, np.uint64), 1
        while have < n:  # doubling: table[h:2h] = table[:h] * base^h
            k = min(have, n - have)
            table[have : have + k] = table[:k] * np.uint64(pow(base, have, 1 << 64))
            have += k
        out.append(table)
    return out[0], out[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[k] = sum of values[i] * BASE^i for i < k; feeds ``span_hash``.  Hashes are independent where values are."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(len(values) + 1)[0][: len(values)], out=p[1:])
    return p


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the span lies."""
    return mix((prefix[end] - prefix[start]) * _power_table(len(prefix))[1][start])


def byte_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    return prefix_hash(_byte_values(seed)[data])


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of a chunk, and for each document the index of its first word
    (one more entry at the end).  Words are maximal runs without ASCII white space and never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return span_hash(byte_prefix(data, seed), starts, ends)


# --- runs of positions ---------------------------------------------------------------------------------------------


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mask of the positions below n that lie in [start, start + length) of any span."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned integers, plane by plane, so that empty planes vanish under compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """array<long> column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int64)))


def marks_by_document(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: all its packed runs (``marks`` has key, runs).  Bounded by the document's own length."""
    return marks.groupBy(key).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def doc_runs(docs: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(doc ids, array<long> of packed runs) from (doc, position) pairs in any order."""
    order = np.lexsort((positions, docs))
    return sorted_doc_runs(docs[order], positions[order])


def sorted_doc_runs(d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    if not len(d):
        return d, list_array(p, np.zeros(0, np.int64))
    new = np.empty(len(d), bool)
    new[0], new[1:] = True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(d)))
    if count.max() > RUN_MASK:  # one run longer than a packed count holds: cut it
        cut = np.zeros(len(d), bool)
        for f, c in zip(first[count > RUN_MASK], count[count > RUN_MASK], strict=True):
            cut[f : f + c : RUN_MASK] = True
        first = np.flatnonzero(new | cut)
        count = np.diff(np.append(first, len(d)))
    packed = (p[first].astype(np.int64) << RUN_BITS) | count
    head = np.flatnonzero(np.concatenate(([True], d[first][1:] != d[first][:-1])))
    return d[first][head], list_array(packed, np.diff(np.append(head, len(first))))


def unpack_runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count) of every packed run of an array<long> column; null lists have none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(col)), lens), flat >> RUN_BITS, flat & RUN_MASK
