"""Token ids stored in doc_id order as Re-Pair grammars, with random access by document.

A shard holds consecutive documents of about ``SHARD_IDS`` ids.  Re-Pair replaces frequent adjacent pairs of symbols by
nonterminals, round after round, each round taking the frequent pairs of the shard at once (where occurrences overlap,
the more frequent pair wins), until no pair occurs ``LEAST_COUNT`` times.  The shard stores the rules, the length that
each symbol expands to, the remaining symbols, and for each document its first symbol, so one document is decoded
without the others.  No pair spans two documents.

A shard is one binary value beside the list of its documents, so ``documents`` finds the shards of some ids without
opening the others.  Shards are rows of a Parquet table in the shared folder, so that Spark's committer makes the write
safe when executors are lost, in any file system that Spark reaches.

Shard layout, little-endian: magic "RPG1"; five uint32: documents, rules, symbols, ids, first nonterminal; int64 doc ids;
uint8 1 where the doc id is null; uint32 first symbol of each document and one more; uint32 left and right symbols of
the rules; uint32 expansion lengths of the rules; the low uint16 of all symbols; their high
uint8, where there are more than 65536 symbols.

Defined cases: a null or empty text is the end id alone; null doc ids come first; rows that share a doc_id follow each
other, ordered by the hash of their text; a text of any length stays in one shard; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from . import tokenization

END = 2
SHARD_IDS = 1 << 20
LEAST_COUNT = 16  #: a pair seen this often in a shard is replaced; at the end no pair is
BROADCAST_PARTS = 1 << 20
BIN_BITS = 17  #: the tables of bins stay in a core's cache
_SHARDS = "part int, shard int, start long, n_ids long, doc_ids array<long>, blob binary"


def _pairs(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """One number a pair: of 32 bits where symbols have 16."""
    kind, bits = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
    return left.astype(kind) << kind(bits) | right.astype(kind)


def _cells(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BIN_BITS)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.uint32)


def grammar(ids: np.ndarray, base: int, last: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): rule k stands for symbols left[k], right[k] and has the number base + k.

    Rounds go on until no pair inside a document occurs ``LEAST_COUNT`` times.  After the first, only pairs with a new
    symbol, or frequent ones left over, can be frequent, so a round looks at those places alone.
    """
    seq = ids.astype(np.int32)
    lefts, rights, rules = [], [], 0
    ends = np.zeros(base, bool)  # symbols whose expansion ends a document
    ends[last] = True
    live = None  # places whose pair may be frequent; at first all
    while len(seq) > 1 and (live is None or len(live)):
        key = _pairs(seq[:-1], seq[1:], base) if live is None else _pairs(seq[live], seq[live + 1], base + rules)
        # a pair can only be frequent if its bin is: the others are never sorted
        cell = _cells(key)
        busy = np.bincount(cell, minlength=1 << BIN_BITS) >= LEAST_COUNT
        if live is None:
            live = some = np.flatnonzero(busy[cell] & ~ends[seq[:-1]])
        else:
            some = np.flatnonzero(busy[cell])
            live = live[some]
        key, cell = key[some], cell[some]
        pairs, counts = np.unique(key, return_counts=True)
        frequent = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(frequent):
            break
        chosen = pairs[frequent[np.argsort(-counts[frequent], kind="stable")]]  # most frequent first
        home = np.zeros(1 << BIN_BITS, np.int32)  # 1 + index in chosen; of two in one bin the more frequent stays, the other waits a round
        homes = _cells(chosen)
        home[homes[::-1]] = np.arange(len(chosen), 0, -1)
        at = home[cell] - 1
        is_pair = (at >= 0) & (chosen[at] == key)
        waits = np.zeros(1 << BIN_BITS, bool)
        waits[homes[home[homes] - 1 != np.arange(len(chosen))]] = True
        waiting = live[waits[cell] & ~is_pair]
        live, at = live[is_pair], at[is_pair]
        # where occurrences overlap the more frequent pair wins; of a run of one pair every second is taken
        score = np.zeros(len(seq) + 1, np.int32)
        score[live + 1] = len(chosen) - at
        here = score[live + 1]
        first_of_run = np.concatenate(([True], (live[1:] != live[:-1] + 1) | (here[1:] != here[:-1])))
        run_start = np.maximum.accumulate(np.where(first_of_run, live, 0))
        take = (here >= score[live]) & (here >= score[live + 2]) & ((live - run_start) & 1 == 0)
        # a rule that this round would use less often waits, as it would cost more than it saves; the most frequent pair never does
        uses = np.bincount(at[take], minlength=len(chosen))
        enough = uses >= max(1, LEAST_COUNT // 4)
        take &= enough[at]
        used = np.flatnonzero(enough)
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        new = base + rules
        half = chosen.dtype.itemsize * 4
        lefts.append((chosen[used] >> chosen.dtype.type(half)).astype(np.int64))
        rights.append((chosen[used] & chosen.dtype.type((1 << half) - 1)).astype(np.int64))
        ends = np.concatenate((ends, ends[rights[-1]]))
        rules += len(used)
        which = np.flatnonzero(take)
        taken = live[which]
        seq[taken] = new + number[at[which]]
        stay = np.ones(len(seq), bool)
        stay[taken + 1] = False
        look = np.zeros(len(seq), bool)  # places to look at in the next round
        look[live] = True
        look[waiting] = True
        keep = np.flatnonzero(stay)
        look, seq = look[keep], seq[keep]
        fresh = np.flatnonzero(seq >= new)
        look[np.maximum(fresh - 1, 0)] = True
        live = np.flatnonzero(look[:-1])
        live = live[~ends[seq[live]]]
    none = [np.zeros(0, np.int64)]
    return seq.astype(np.int64), np.concatenate(lefts or none), np.concatenate(rights or none)


def _layers(left: np.ndarray, right: np.ndarray, base: int):
    """Ranges of rules that only use rules of ranges before."""
    last, a = np.maximum(left, right) - base, 0
    while a < len(left):
        late = np.flatnonzero(last[a:] >= a)
        b = a + int(late[0]) if len(late) else len(left)
        yield a, b
        a = b


def rule_sizes(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size = np.ones(base + len(left), np.int64)
    for a, b in _layers(left, right, base):
        size[base + a : base + b] = size[left[a:b]] + size[right[a:b]]
    return size[base:]


def expansions(left: np.ndarray, right: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): the ids that each rule stands for, end to end."""
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(start[-1]), np.int32)
    for a, b in _layers(left, right, base):
        symbol = np.stack((left[a:b], right[a:b]), 1).reshape(-1)
        single = symbol < base
        rule = np.where(single, 0, symbol - base)
        length = np.where(single, 1, size[rule])
        to = start[a] + np.cumsum(length) - length
        out[to[single]] = symbol[single]
        to, length, begin = to[~single], length[~single], start[rule[~single]]
        ramp = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + ramp] = out[np.repeat(begin, length) + ramp]
    return out, start[:-1]


def expand(seq: np.ndarray, table: tuple[np.ndarray, np.ndarray], size: np.ndarray, base: int) -> np.ndarray:
    """Symbols to ids: one gather from the ids of single symbols and those of the rules."""
    ids, start = table
    rule = seq >= base
    which = np.where(rule, seq - base, 0)
    length = np.where(rule, size[which], 1) if len(size) else np.ones(len(seq), np.int64)
    if not rule.any():
        return seq.astype(np.int64)
    # single symbols are read from a copy of the sequence behind the rules' ids
    source = np.concatenate((ids, seq.astype(np.int32)))
    begin = np.where(rule, start[which], len(ids) + np.arange(len(seq)))
    end = np.cumsum(length)
    return source[np.repeat(begin - (end - length), length) + np.arange(int(end[-1]))]


def encode_shard(doc_ids: list[int | None], parts: list[bytes], base: int) -> bytes:
    """``parts``: each document's ids with the end id, as little-endian uint32."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    seq, left, right = grammar(ids, base)
    size = np.concatenate((np.ones(base, np.int64), rule_sizes(left, right, base)))
    symbol_at = np.concatenate(([0], np.cumsum(size[seq])))
    id_at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
    first = np.searchsorted(symbol_at, id_at)
    return b"".join((
        b"RPG1", struct.pack("<5I", len(parts), len(left), len(seq), len(ids), base),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        first.astype("<u4").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), size[base:].astype("<u4").tobytes(),
        (seq & 0xFFFF).astype("<u2").tobytes(), (seq >> 16).astype("u1").tobytes() if base + len(left) > 1 << 16 else b"",
    ))


class Shard:
    """Reads an encoded shard: ``document(i)`` decodes one document, ``all_ids()`` every one."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"RPG1":
            raise ValueError("not a shard")
        docs, rules, symbols, self.n_ids, self.base = struct.unpack_from("<5I", blob, 4)
        at = 24

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.first, self.left, self.right, self.size = (take("<u4", n).astype(np.int64) for n in (docs + 1, rules, rules, rules))
        self.symbols = take("<u2", symbols).astype(np.int64)
        if self.base + rules > 1 << 16:
            self.symbols |= take("u1", symbols).astype(np.int64) << 16

    def lengths(self) -> np.ndarray:
        """Ids of each document, from expansion lengths alone."""
        size = np.concatenate((np.ones(self.base, np.int64), self.size))[self.symbols]
        total = np.concatenate(([0], np.cumsum(size)))
        return np.diff(total[self.first])

    @cached_property
    def _table(self):
        return expansions(self.left, self.right, self.size, self.base)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.first[i] : self.first[i + 1]], self._table, self.size, self.base)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self._table, self.size, self.base)


def write_store(docs: DataFrame, path: str | None = None, end_id: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards, written to the shared folder: part and shard ascend with doc_id; start counts ids in the part."""
    spark = docs.sparkSession
    C.tune(spark)
    path = path or tokenization.default_path()
    schema = C.arrow_schema(_SHARDS)
    end = end_id.to_bytes(4, "little")
    parts = max(spark.sparkContext.defaultParallelism, C.input_bytes(docs) >> 24)

    def run(batches):
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        base = tokenization.encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
        ids: list[bytes] = []
        names: list[int | None] = []

        def out():
            nonlocal shard, start, ids, names
            n = sum(map(len, ids)) // 4
            row = pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip((part, shard, start, n, names, encode_shard(names, ids, base)), schema, strict=True)], schema=schema)
            shard, start, ids, names = shard + 1, start + n, [], []
            return row

        size = 0
        for batch, data, off in C.chunks(batches):
            for doc_id, x in zip(C.column(batch, "doc_id").to_pylist(), tokenization.encode_batch(path, data, off), strict=True):
                if size and size + len(x) // 4 >= shard_ids:
                    yield out()
                    size = 0
                ids.append(x + end)
                names.append(doc_id)
                size += len(x) // 4 + 1
        if names:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return C.written(ordered.mapInArrow(run, _SHARDS.replace(", ", ",")))


def read_store(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded; start counts all ids before it."""
    total = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per part: as many as tasks that wrote
    before = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).cast("long").alias("before"))
    if total.count() <= BROADCAST_PARTS:  # sixteen bytes each; beyond that both sides are shuffled by part
        before = F.broadcast(before)
    placed = shards.join(before, "part").select((F.col("before") + F.col("start")).alias("start"), "blob")
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = C.arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_buffer().to_pybytes())
                ids = shard.all_ids().astype("<u4")
                n = shard.lengths()
                at = np.concatenate(([0], np.cumsum(n)))
                each = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [shard.doc_ids, start + at[:-1], n, [zlib.crc32(x) for x in each], *([[x.astype(np.int32) for x in each]] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(cols, schema, strict=True)], schema=schema)

    return placed.mapInArrow(run, ddl.replace(", ", ","))


def documents(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted``; an id that the store lacks has no row, a shared one a row each.

    The lists of documents, not the shards, meet the wanted ids; then only the shards that hold one are read, and in
    them only those documents are expanded.
    """
    at = shards.select("part", "shard", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    places = at.groupBy("part", "shard").agg(F.array_sort(F.collect_list("place")).alias("places"))  # no more than a shard holds

    def run(batches):
        for batch in batches:
            for places, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[k] for k in places], pa.int64()), pa.array([shard.document(k).astype(np.int32) for k in places], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shards.join(places, ["part", "shard"]).select("places", "blob").mapInArrow(run, "doc_id long,ids array<int>")
