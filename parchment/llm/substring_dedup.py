"""Exact substring dedup over words with difference-cover anchors.

Two equal windows of ``WINDOW`` words at positions i and j share, for some shift d below the period, an anchor that
starts at i+d and at j+d with both (i+d) and (j+d) in the difference cover modulo the period.  So only the anchors at
cover positions (4 of 13) are hashed and shuffled; a window can only repeat if it holds an anchor that does.  The
anchors that do repeat are then extended: the windows around them are compared by a 96-bit hash of all their words,
and every window but the first of its kind (by doc_id, then start) is cut out.

Both shuffles are pre-aggregated where the text is: what repeats inside one chunk is settled there, and one
representative a chunk goes on, so a passage that a third of all documents share sends a row per chunk and not per
document.  A task holds one hash bucket at a time.

Defined cases: a null or empty text has no words; a text under 20 words is kept whole; a null doc_id is returned with
its text untouched and is not compared; rows that share a doc_id are pooled (the same text twice under one id is one
document, both rows are returned); other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1

_CARRIED = "bucket int, n int, blob binary, doc_id long, runs array<long>"
_MARKS = "doc_id long, runs array<long>"


def _pack(h: list[np.ndarray], docs: np.ndarray, pos: np.ndarray) -> bytes:
    step = np.diff(docs, prepend=0)
    return b"".join([*(C.planes(x, 6) for x in h), C.planes(step.view(np.uint64), 8), C.planes(pos.astype(np.uint64), 5)])


def _unpack(raw: bytes, n: int, hashes: int) -> list[np.ndarray]:
    view, out, at = memoryview(raw), [], 0
    for width in (*[6] * hashes, 8, 5):
        out.append(C.from_planes(view[at : at + n * width], n, width))
        at += n * width
    out[-2] = np.cumsum(out[-2].view(np.int64))
    return out


def carried_rows(bits: int, h: list[np.ndarray], docs: np.ndarray, pos: np.ndarray, settled: tuple[np.ndarray, pa.Array]) -> dict:
    """Rows of one chunk for the next shuffle: a blob for each hash bucket, and the settled runs, dealt by document."""
    bucket = (h[0] >> np.uint64(64 - bits)).astype(np.int64)
    key = np.sort(bucket << 40 | np.arange(len(bucket)))
    idx, bucket = key & ((1 << 40) - 1), key >> 40
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(idx) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(idx)) if len(idx) else cut
    blobs = [_pack([x[idx[a:b]] for x in h], docs[idx[a:b]], pos[idx[a:b]]) for a, b in zip(cut, ends, strict=True)]
    sd, runs = settled
    k, none = len(blobs), len(sd)
    own = (C.mix(sd.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return {
        "bucket": np.concatenate((bucket[cut], own)).astype(np.int32),
        "n": np.concatenate((ends - cut if k else cut, np.zeros(none, np.int64))).astype(np.int32),
        "blob": pa.array([*blobs, *[None] * none], pa.binary()),
        "doc_id": pa.array([*[None] * k, *sd.tolist()], pa.int64()),
        "runs": pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), runs.cast(pa.list_(pa.int64()))]),
    }


def settle(rows: DataFrame, hashes: int, choose) -> DataFrame:
    """One hash bucket after another: ``choose(hashes, docs, pos)`` gives a mask of the (doc, position) pairs to mark;
    settled runs pass through."""
    schema = C.arrow_schema(_MARKS)

    def run(table: pa.Table) -> pa.Table:
        keep = table.column("blob").is_valid()
        out = [table.filter(pa.compute.invert(keep)).select(["doc_id", "runs"]).cast(schema)]
        own = table.filter(keep)
        if own.num_rows:
            parts = [_unpack(b, n, hashes) for b, n in zip(own.column("blob").to_pylist(), own.column("n").to_pylist(), strict=True)]
            *h, docs, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            pos = pos.astype(np.int64)
            mask = choose(h, docs, pos)
            d, runs = C.doc_runs(docs[mask], pos[mask])
            out.append(pa.Table.from_arrays([pa.array(d, pa.int64()), runs], schema=schema))
        return pa.concat_tables(out)

    return rows.groupBy("bucket").applyInArrow(run, _MARKS.replace(", ", ","))


def repeated(h, docs, pos) -> np.ndarray:
    """Those whose hash occurs more than once."""
    order = np.argsort(h[0])
    same = h[0][order][1:] == h[0][order][:-1]
    mask = np.zeros(len(docs), bool)
    mask[order[1:][same]] = True
    mask[order[:-1][same]] = True
    return mask


def not_first(h, docs, pos) -> np.ndarray:
    """Those for which the same hashes occur at a smaller (doc, position)."""
    order = np.lexsort((pos, docs, h[1], h[0]))
    a, b = h[0][order], h[1][order]
    d, p = docs[order], pos[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    mask = np.zeros(len(docs), bool)
    mask[order[(d != d[first]) | (p != p[first])]] = True
    return mask


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = C.column(batch, "doc_id")
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


def anchors(docs: DataFrame, window: int, bits: int) -> DataFrame:
    reach = window - PERIOD + 1

    def one(batch, data, off):
        ids, valid = _ids(batch)
        starts, ends, first = C.word_spans(data, off)
        words = C.word_hashes(data, starts, ends, 1)
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        local = np.arange(len(starts)) - first[doc]
        at = np.flatnonzero(np.isin(local % PERIOD, COVER) & (local + reach <= counts[doc]) & (counts[doc] >= window) & valid[doc])
        h = C.span_hash(C.prefix_hash(words), at, at + reach)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        rep = np.sort(order[np.concatenate(([True], ~same))]) if len(at) else order
        a = at[twice]
        yield carried_rows(bits, [h[rep]], ids[doc[at[rep]]], local[at[rep]], C.doc_runs(ids[doc[a]], local[a]))

    return C.map_arrow(docs, one, _CARRIED)


def extended(joined: DataFrame, window: int, bits: int) -> DataFrame:
    """Windows around repeated anchors; within a chunk all but the first of equal windows are settled."""

    def one(batch, data, off):
        row, start, count = C.unpack_runs(C.column(batch, "runs"))
        if not len(row):
            return
        ids, _ = _ids(batch)
        starts, ends, first = C.word_spans(data, off)
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        local = np.arange(len(starts)) - first[doc]
        back = np.maximum(start - (PERIOD - 1), 0)
        near = C.cover(len(starts), first[row] + back, start + count - back)
        at = np.flatnonzero(near & (local + window <= counts[doc]))
        if not len(at):
            return
        h1, h2 = (C.span_hash(C.prefix_hash(C.word_hashes(data, starts, ends, s)), at, at + window) for s in (5, 6))
        d, p = ids[doc[at]], local[at]
        mask = not_first([h1, h2], d, p)
        rest = np.flatnonzero(~mask)
        if len(rest) > 1:  # rows repeated under one id leave equal (doc, position) pairs; one is enough
            rest = rest[np.lexsort((p[rest], d[rest]))]
        yield carried_rows(bits, [h1[rest], h2[rest]], d[rest], p[rest], C.doc_runs(d[mask], p[mask]))

    return C.map_arrow(joined, one, _CARRIED)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, runs): every document with the packed runs of window starts that occur earlier.

    The documents are shuffled once by doc_id and that exchange serves both joins.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    C.tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = C.bucket_count(docs).bit_length() - 1
    found = C.marks_by_document(settle(anchors(docs, window, bits), 1, repeated))
    near = docs.join(found, "doc_id", "left")
    late = C.marks_by_document(settle(extended(near, window, bits), 2, not_first))
    return docs.join(late, "doc_id", "left")


def kept_words(marked: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of ``substring_dedup``'s rows."""

    def one(batch, data, off):
        row, start, count = C.unpack_runs(C.column(batch, "runs"))
        lo = np.searchsorted(row, np.arange(batch.num_rows + 1))
        raw = data.tobytes()
        n_words, n_removed, sha, kept_text = [], [], [], []
        for i in range(batch.num_rows):
            words = raw[off[i] : off[i + 1]].split()
            n = len(words)
            if lo[i + 1] > lo[i]:
                gone = C.cover(n, start[lo[i] : lo[i + 1]], count[lo[i] : lo[i + 1]] + window - 1)
                words = [words[k] for k in np.flatnonzero(~gone)]
            kept = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode())
        yield {"doc_id": C.column(batch, "doc_id"), "n_words": n_words, "n_removed": n_removed, "kept_sha256": sha, "kept_text": kept_text}

    return C.map_arrow(marked, one, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
