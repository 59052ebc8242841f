"""Exact byte-substring dedup by a depth-limited most-significant-digit radix sort of suffixes.

Every string of ``DEPTH`` bytes that starts at two places is found by ordering suffixes by their first DEPTH bytes
only.  The passes, most significant first:

1. The first digit is content-defined: the minimizer of the window, the 192-byte gram of least hash in it.  Equal
   windows have equal minimizers at equal offsets, so this digit deals the suffixes out without ever splitting a group.
   Neighbouring suffixes share a minimizer (about 100 at a time), so it costs one row a run and not one a byte.
   Runs whose minimizer is unique end here.
2. Whole runs are compared: the windows of two identical runs are all repeated.  One of each kind goes on, and only
   where its minimizer also has runs of another kind.
3. The text of those runs is dealt out by minimizer, and their suffixes are refined by digits of 80 bytes, five passes
   to the depth; groups of one drop out at each pass.  What is left in groups after the last are exactly the repeated
   windows.  A minimizer with many kinds of runs (a passage in ever other surroundings) would meet in one task: its
   suffixes are dealt by a digit of the whole depth instead, window by window, so that only equal ones meet.

Identical runs of one chunk are settled in it and send one representative, so copies that make up a third of the rows
send a row per chunk.  A task holds one bucket of minimizers at a time.

Defined cases: a null text is empty; under 400 bytes nothing is removed; a null doc_id is returned untouched and not
compared; rows that share a doc_id are pooled, and each starts its strings anew, so such a text repeated is removed;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import substring_dedup as S

DEPTH = 400
GRAM = 192
DIGIT = 80
#: Kinds of runs under one minimizer above which their windows are dealt one by one rather than with their text.
CROWD = 48
_ONE_BY_ONE = 1 << 20

_RUNS = "bucket int, n int, blob binary, doc_id long, runs array<long>"
_FOUND = "doc_id long, runs array<long>, wanted array<long>"
_TEXTS = "bucket int, n int, meta binary, body binary, blob binary, doc_id long, runs array<long>"
_WIDTHS = (6, 6, 6, 8, 5, 2, 2)  # minimizer, two hashes of the run, document step, start, count, offset of the minimizer


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """min(key[s : s + width]) for every s, by block-wise prefix and suffix minima."""
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def super_windows(data: np.ndarray, off: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in chunk, count, minimizer position, minimizer hash) of the runs of windows that share a minimizer."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none, none.view(np.uint64)
    at = np.arange(n - gram + 1)
    h = C.span_hash(C.byte_prefix(data, 11), at, at + gram)
    bits = np.uint64(max(24, n.bit_length()))
    best = window_minima(h >> bits << bits | at.astype(np.uint64), depth - gram + 1)
    where = (best & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    long = np.flatnonzero(np.diff(off) >= depth)
    valid = C.cover(len(where), off[long], off[long + 1] - depth + 1 - off[long])
    new = valid.copy()
    new[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True]))) + 1
    row = np.searchsorted(off, start, "right") - 1
    m = where[start]
    return row, start, stop - start, m, h[m]


def _pack(cols: list[np.ndarray]) -> bytes:
    cols = [*cols[:3], np.diff(cols[3], prepend=0).view(np.uint64), *cols[4:]]
    return b"".join(C.planes(x.astype(np.uint64, copy=False), w) for x, w in zip(cols, _WIDTHS, strict=True))


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    view, at, out = memoryview(raw), 0, []
    for w in _WIDTHS:
        out.append(C.from_planes(view[at : at + n * w], n, w))
        at += n * w
    out[3] = np.cumsum(out[3].view(np.int64))
    return [*out[:3], *(x.astype(np.int64) for x in out[3:])]


def _marks(docs: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Packed runs by document from spans of starts that don't overlap."""
    order = np.lexsort((start, docs))
    d, s, c = docs[order], start[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.zeros(0, np.int64)
    return d[head], C.list_array(s << C.RUN_BITS | c, np.diff(np.append(head, len(d))))


def _own_bucket(docs: np.ndarray, bits: int) -> np.ndarray:
    return (C.mix(docs.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(key):
        return key.astype(np.int64), key.astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return cut, np.append(cut[1:], len(key))


def first_digit(docs: DataFrame, depth: int, gram: int, bits: int) -> DataFrame:
    def one(batch, data, off):
        col = C.column(batch, "doc_id")
        ids, known = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)
        row, start, count, m, mini = super_windows(data, off, depth, gram)
        keep = known[row]
        row, start, count, m, mini = (x[keep] for x in (row, start, count, m, mini))
        if not len(row):
            return
        end = start + count - 1 + depth
        h1 = C.span_hash(C.byte_prefix(data, 12), start, end)
        h2 = C.span_hash(C.byte_prefix(data, 13), start, end)
        twice, rep = _both_repeated(h1, h2)
        sd, sruns = _marks(ids[row[twice]], (start - off[row])[twice], count[twice])
        bucket = (C.mix(mini[rep]) >> np.uint64(64 - bits)).astype(np.int64)  # mixed: the least of many hashes is small
        by = np.argsort(bucket, kind="stable")
        rep, bucket = rep[by], bucket[by]
        cols = [mini, h1, h2, ids[row], start - off[row], count, m - start]
        a, b = _cuts(bucket)
        blobs = [_pack([x[rep[i:j]] for x in cols]) for i, j in zip(a, b, strict=True)]
        k, s = len(blobs), len(sd)
        yield {
            "bucket": np.concatenate((bucket[a].astype(np.int32), _own_bucket(sd, bits))),
            "n": np.concatenate(((b - a) if k else a, np.zeros(s, np.int64))).astype(np.int32),
            "blob": pa.array([*blobs, *[None] * s], pa.binary()),
            "doc_id": pa.array([*[None] * k, *sd.tolist()], pa.int64()),
            "runs": pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), sruns.cast(pa.list_(pa.int64()))]),
        }

    return C.map_arrow(docs, one, _RUNS)


def whole_runs(rows: DataFrame) -> DataFrame:
    """Pass 2: marks for identical runs, and the runs whose text is wanted as [packed run, offset, minimizer]."""
    schema = C.arrow_schema(_FOUND)
    lists = pa.list_(pa.int64())

    def run(table: pa.Table) -> pa.Table:
        keep = table.column("blob").is_valid()
        old = table.filter(pc.invert(keep))
        out = [pa.Table.from_arrays([old.column("doc_id"), old.column("runs").cast(lists), pa.nulls(old.num_rows, lists)], schema=schema)]
        own = table.filter(keep)
        if own.num_rows:
            parts = [_unpack(b, n) for b, n in zip(own.column("blob").to_pylist(), own.column("n").to_pylist(), strict=True)]
            mini, h1, h2, docs, start, count, rel = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h2, h1, mini))
            mini, h1, h2, docs, start, count, rel = (x[order] for x in (mini, h1, h2, docs, start, count, rel))
            group = np.concatenate(([True], mini[1:] != mini[:-1]))
            kind = np.concatenate(([True], (mini[1:] != mini[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            kind_no, group_no = np.cumsum(kind) - 1, np.cumsum(group) - 1
            twice = np.bincount(kind_no)[kind_no] > 1
            d, runs = _marks(docs[twice], start[twice], count[twice])
            out.append(pa.Table.from_arrays([pa.array(d, pa.int64()), runs.cast(lists), pa.nulls(len(d), lists)], schema=schema))
            kinds = np.bincount(group_no[kind])[group_no]
            want = kind & (kinds > 1)
            rel = np.where(kinds > CROWD, rel + _ONE_BY_ONE, rel)
            if want.any():
                w = np.flatnonzero(want)
                w = w[np.argsort(docs[w], kind="stable")]
                triple = np.stack([start[w] << C.RUN_BITS | count[w], rel[w], mini[w].view(np.int64)], 1).reshape(-1)
                a, b = _cuts(docs[w])
                out.append(pa.Table.from_arrays([pa.array(docs[w][a], pa.int64()), pa.nulls(len(a), lists), C.list_array(triple, 3 * (b - a)).cast(lists)], schema=schema))
        return pa.concat_tables(out)

    return rows.groupBy("bucket").applyInArrow(run, _FOUND.replace(", ", ","))


def _one_by_one(data, off, row, start, count, doc, depth: int, bits: int) -> dict:
    """Rows for windows dealt by the hash of their whole depth; those that repeat in the chunk are settled."""
    seg = np.repeat(np.arange(len(count)), count)
    pos = start[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row[seg]] + pos
    h1, h2 = (C.span_hash(C.byte_prefix(data, k), at, at + depth) for k in (12, 13))
    twice, rep = _both_repeated(h1, h2)
    docs = doc[seg]
    return S.carried_rows(bits, [h1[rep], h2[rep]], docs[rep], pos[rep], C.doc_runs(docs[twice], pos[twice]))


def _both_repeated(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of those whose pair of hashes repeats, indexes of the first of each pair in order)."""
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    mask = np.zeros(len(h1), bool)
    mask[order[1:][same]] = True
    mask[order[:-1][same]] = True
    return mask, np.sort(order[np.concatenate(([True], ~same))]) if len(order) else order


def wanted_texts(joined: DataFrame, depth: int, bits: int) -> DataFrame:
    """The text of the wanted runs, dealt by minimizer; marks pass through, dealt by document."""
    def one(batch, data, off):
        ids = C.column(batch, "doc_id")
        have = C.column(batch, "runs")
        some = pc.greater(pc.fill_null(pc.list_value_length(have), 0), 0)
        sd, sruns = ids.filter(some), have.filter(some)
        want = C.column(batch, "wanted")
        lens = pc.fill_null(pc.list_value_length(want), 0).to_numpy(zero_copy_only=False) // 3
        triple = want.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
        row = np.repeat(np.arange(batch.num_rows), lens)
        start, count, rel, mini = triple[:, 0] >> C.RUN_BITS, triple[:, 0] & C.RUN_MASK, triple[:, 1], triple[:, 2].view(np.uint64)
        size = count - 1 + depth
        fits = off[row] + start + size <= off[row + 1]  # not so only where another row has the same doc_id
        row, start, count, rel, mini, size = (x[fits] for x in (row, start, count, rel, mini, size))
        doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        crowd = rel >= _ONE_BY_ONE
        single = _one_by_one(data, off, row[crowd], start[crowd], count[crowd], doc[crowd], depth, bits) if crowd.any() else None
        row, start, count, rel, mini, size, doc = (x[~crowd] for x in (row, start, count, rel, mini, size, doc))
        bucket = (C.mix(mini) >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        a, b = _cuts(bucket[by])
        meta, body = [], []
        for i, j in zip(a, b, strict=True):
            w = by[i:j]
            meta.append(np.stack([mini[w].view(np.int64), doc[w], start[w], count[w], rel[w]]).astype("<i8").tobytes())
            body.append(b"".join(data[off[r] + s : off[r] + s + z].tobytes() for r, s, z in zip(row[w], start[w], size[w], strict=True)))
        k, s = len(meta), len(sd)
        lists = pa.list_(pa.int64())
        own = _own_bucket(sd.to_numpy(zero_copy_only=False), bits) if s else np.zeros(0, np.int32)
        if k + s:
            yield {
                "bucket": np.concatenate((bucket[by][a].astype(np.int32), own)),
                "n": np.concatenate(((b - a) if k else a, np.zeros(s, np.int64))).astype(np.int32),
                "meta": pa.array([*meta, *[None] * s], pa.binary()),
                "body": pa.array([*body, *[None] * s], pa.binary()),
                "blob": pa.nulls(k + s, pa.binary()),
                "doc_id": pa.concat_arrays([pa.nulls(k, pa.int64()), sd]),
                "runs": pa.concat_arrays([pa.nulls(k, lists), sruns.cast(lists)]),
            }
        if single:
            yield {**single, "meta": pa.nulls(len(single["n"]), pa.binary()), "body": pa.nulls(len(single["n"]), pa.binary())}

    return C.map_arrow(joined, one, _TEXTS)


def radix_groups(group: np.ndarray, at: np.ndarray, prefix: np.ndarray, depth: int, digit: int) -> np.ndarray:
    """Indexes of the suffixes ``at`` whose first ``depth`` bytes occur twice or more; ``group`` is the first digit."""
    live = np.arange(len(at))
    for k in range(0, depth, digit):
        key = C.span_hash(prefix, at[live] + k, at[live] + min(k + digit, depth))
        order = np.lexsort((key, group))
        g, d = group[order], key[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        no = np.cumsum(new) - 1
        more = np.bincount(no)[no] > 1
        live, group = live[order[more]], no[more]
        if not len(live):
            break
    return live


def later_digits(rows: DataFrame, depth: int, digit: int) -> DataFrame:
    schema = C.arrow_schema("doc_id long, runs array<long>")

    def run(table: pa.Table) -> pa.Table:
        keep, single = table.column("meta").is_valid(), table.column("blob").is_valid()
        out = [table.filter(pc.invert(pc.or_(keep, single))).select(["doc_id", "runs"]).cast(schema)]
        alone = table.filter(single)
        if alone.num_rows:
            parts = [S._unpack(b, n, 2) for b, n in zip(alone.column("blob").to_pylist(), alone.column("n").to_pylist(), strict=True)]
            h1, h2, docs, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask = _both_repeated(h1, h2)[0]
            d, runs = C.doc_runs(docs[mask], pos[mask].astype(np.int64))
            out.append(pa.Table.from_arrays([pa.array(d, pa.int64()), runs.cast(pa.list_(pa.int64()))], schema=schema))
        own = table.filter(keep)
        if own.num_rows:
            meta = np.concatenate([np.frombuffer(m, "<i8").reshape(5, -1) for m in own.column("meta").to_pylist()], axis=1)
            body = np.frombuffer(b"".join(own.column("body").to_pylist()), np.uint8)
            mini, docs, start, count, rel = meta
            base = np.concatenate(([0], np.cumsum(count - 1 + depth)))[:-1]
            seg = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(seg)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
            # suffixes that share a minimizer are equal only where it lies at the same offset in them
            first = np.stack([mini[seg], rel[seg] - step], 1)
            order = np.lexsort((first[:, 1], first[:, 0]))
            f = first[order]
            no = np.cumsum(np.concatenate(([True], (f[1:] != f[:-1]).any(axis=1)))) - 1
            group = np.empty(len(order), np.int64)
            group[order] = no
            hit = radix_groups(group, base[seg] + step, C.byte_prefix(body, 17), depth, digit)
            d, runs = C.doc_runs(docs[seg[hit]], start[seg[hit]] + step[hit])
            out.append(pa.Table.from_arrays([pa.array(d, pa.int64()), runs.cast(pa.list_(pa.int64()))], schema=schema))
        return pa.concat_tables(out)

    return rows.groupBy("bucket").applyInArrow(run, "doc_id long,runs array<long>")


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, runs): every document with the packed runs of starts of strings that occur elsewhere too.

    The documents are shuffled once by doc_id and that exchange serves both joins.
    """
    if depth < 2 * gram:
        raise ValueError("the depth is at least two grams")
    C.tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = C.bucket_count(docs).bit_length() - 1
    found = whole_runs(first_digit(docs, depth, gram, bits)).groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("wanted")).alias("wanted"))
    marks = C.marks_by_document(later_digits(wanted_texts(docs.join(found, "doc_id", "left"), depth, bits), depth, DIGIT))
    return docs.join(marks, "doc_id", "left")


def kept_bytes(marked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``suffix_dedup``'s rows."""

    def one(batch, data, off):
        row, start, count = C.unpack_runs(C.column(batch, "runs"))
        lo = np.searchsorted(row, np.arange(batch.num_rows + 1))
        gone_n, spans, sha = [], [], []
        for i in range(batch.num_rows):
            own = data[off[i] : off[i + 1]]
            removed = n_spans = 0
            if lo[i + 1] > lo[i]:
                gone = C.cover(len(own), start[lo[i] : lo[i + 1]], count[lo[i] : lo[i + 1]] + depth - 1)
                removed, n_spans = int(gone.sum()), len(C.runs_of(gone)[0])
                own = own[~gone]
            gone_n.append(removed)
            spans.append(n_spans)
            sha.append(hashlib.sha256(own.tobytes()).hexdigest())
        yield {"doc_id": C.column(batch, "doc_id"), "n_bytes": np.diff(off), "n_removed": gone_n, "n_spans": spans, "kept_sha256": sha}

    return C.map_arrow(marked, one, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
