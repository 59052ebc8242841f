"""SimHash near-duplicate groups with pigeonring filtering.

A fingerprint of 64 bits is cut into three segments that form a ring.  If two fingerprints differ in at most two bits,
then for some segment the differences of the chain that starts there stay within the budgets in proportion: none in its
first segment, at most one in its first two, at most two in all three.  So fingerprints are dealt by one segment, three
rows each, and inside a bucket the second segment is probed with at most one bit changed; only what the chain admits
reaches the full Hamming check.

``near_groups`` is the setting for near copies in general: five-word shingles, 128 bits, and the radius within which texts
of similarity 0.8 fall nine times in ten.  Thirteen segments form its ring, and the budgets of its chains are 1, 3, 5, ...
bits; the first segment deals the fingerprints out, with one bit flipped at most.  Numbers of distinct shingles must agree
to 0.8 as well, which any pair of that similarity meets.

All work is on distinct fingerprints, so exact copies cost one aggregated row.  A bucket returns a spanning forest of
its links, never pairs; components come from alternating star contraction over written tables, linear rows a round.

Defined cases: a null or empty text has fingerprint zero and links like any other; texts under three words hash the
whole sequence; a null doc_id gets its fingerprint and the component of the others that share it (null if none);
repeated rows return the same class each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHINGLE = 3
SEED = 42
#: (shift, width) of the segments; the ring's order is that of the list.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Key groups above this size are probed bit by bit rather than compared in full; both are exact.
PROBE_ABOVE = 64
BLOCK = 1 << 20


def fingerprint_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority fingerprint of each document from the shingle hashes of all, laid end to end."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ends = np.cumsum(counts)
        ones = np.add.reduceat(bits, (ends - counts)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    C.tune(docs.sparkSession)

    def one(batch, data, off):
        raw, digest = data.tobytes().lower(), xxhash.xxh64_intdigest
        hashes, counts = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            words = raw[a:b].split()
            if len(words) <= shingle:
                got = [digest(b" ".join(words), SEED)] if words else []
            else:
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate(([0], ends[:-1] + 1))
                got = [digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            counts.append(len(got))
            hashes.append(np.array(got, np.uint64))
        fp = fingerprint_bits(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))
        yield {"doc_id": C.column(batch, "doc_id"), "fp": fp.view(np.int64)}

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        live = lo != hi
        if not live.any():
            break
        a, b, lo, hi = a[live], b[live], lo[live], hi[live]
        np.minimum.at(root, hi, lo)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
    return root


def _flips(width: int, most: int) -> np.ndarray:
    one = [1 << i for i in range(width)]
    two = [x | y for i, x in enumerate(one) for y in one[:i]] if most > 1 else []
    return np.array([0, *one, *two], np.uint64)


def chain_links(fp: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints that agree in segment ``ring``, pass its chain and differ in 2 bits at most."""
    (s0, w0), (s1, w1), (s2, w2) = (SEGMENTS[(ring + k) % 3] for k in range(3))
    seg = lambda s, w: fp >> np.uint64(s) & np.uint64((1 << w) - 1)
    key = seg(s0, w0) << np.uint64(w1) | seg(s1, w1)
    order = np.argsort(key, kind="stable")
    keys, first, size = np.unique(key[order], return_index=True, return_counts=True)
    out_a, out_b = [], []

    def check(a, b):
        hit = (np.bitwise_count(fp[a] ^ fp[b]) <= 2) & (a != b)
        out_a.append(a[hit])
        out_b.append(b[hit])

    big = size > PROBE_ABOVE
    everything = np.argsort(fp) if big.any() else None
    sorted_fp = fp[everything] if big.any() else None
    for flip in _flips(w1, 1):
        want = key ^ flip
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        found = np.flatnonzero(keys[at] == want)
        if flip:
            found = found[key[found] < want[found]]  # each pair of keys once
        dense = big[at[found]]
        few = found[~dense]
        n = size[at[few]]
        cut = np.searchsorted(np.cumsum(n), np.arange(BLOCK, int(n.sum()), BLOCK)).tolist()
        for i, j in zip([0, *cut], [*cut, len(few)], strict=True):  # blocks bound the memory
            f, m = few[i:j], n[i:j]
            if len(f):
                a = np.repeat(f, m)
                b = order[np.repeat(first[at[f]], m) + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)]
                check(a, b)
        many = found[dense]
        for rest in _flips(w2, 1 if flip else 2) if len(many) else ():
            target = fp[many] ^ (flip << np.uint64(s1)) ^ (rest << np.uint64(s2))
            p = np.minimum(np.searchsorted(sorted_fp, target), len(sorted_fp) - 1)
            ok = sorted_fp[p] == target
            check(many[ok], everything[p[ok]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(classes: DataFrame, buckets: int = 4096) -> DataFrame:
    """(u, v): a forest that spans each bucket's links, between the representatives of distinct fingerprints."""
    rows = classes.where(F.col("rep").isNotNull()).select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("segment")) for i, (s, w) in enumerate(SEGMENTS)])).alias("k")
    ).select("fp", "rep", F.col("k.ring").alias("ring"), F.pmod(F.hash("k.ring", "k.segment"), F.lit(buckets)).alias("bucket"))
    schema = C.arrow_schema("u long, v long")

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep)
        fp, rep = fp[order], rep[order]  # so that the least index is the least representative
        a, b = chain_links(fp, table.column("ring")[0].as_py())
        root = _roots(len(fp), a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.Table.from_arrays([pa.array(rep[own], pa.int64()), pa.array(rep[root[own]], pa.int64())], schema=schema)

    return rows.groupBy("bucket", "ring").applyInArrow(run, "u long,v long").where("u <> v").distinct()


def _with_least(edges: DataFrame, least: DataFrame, salts: int = 16) -> DataFrame:
    """The edges with the m of their u, dealt by u and a salt, so that the edges of a hub meet in many tasks."""
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return edges.withColumn("_salt", F.pmod(F.hash("v"), F.lit(salts))).join(copies, ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for the nodes of the edges (u > v), by alternating large-star and small-star rounds.

    Rounds end when the edges are stars; each round's edges are written.
    """
    edges = C.written(edges)
    seen = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = C.written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(now)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable by links."""
    marked = C.written(fingerprints(docs, shingle))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(classes, C.bucket_count(docs)))
    # written, so that the join below reads two plain exchanges and adaptive execution can split a fingerprint of many rows
    own = C.written(classes.join(joined, classes.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return marked.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies: wider fingerprints, a wider radius ----------------------------------------------------------------

NEAR_SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
CELLS = 1 << 20  #: pairs compared at a time
_HOLD = 1 << 18  #: links held before they are folded into the forest


def radius_for(similarity: float, bits: int = BITS) -> int:
    """Bits within which nine of ten pairs of that Jaccard similarity differ: the angle between their shingle sets, and its spread."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 1.2816 * math.sqrt(bits * share * (1 - share)))


def ring_of(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(start, width) of the segments: as few as leave the first a budget of one bit."""
    m = radius // 2 + 1
    ends = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def wide_fingerprints(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, hi, lo, n): 128 fingerprint bits and the number of distinct shingles."""
    C.tune(docs.sparkSession)

    def one(batch, data, off):
        raw, digest = data.tobytes().lower(), xxhash.xxh3_128_digest
        sizes, digests = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            words = raw[a:b].split()
            line = b" ".join(words)
            if len(words) <= shingle:
                got = [digest(line, SEED)] if words else []
            else:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate(([0], ends[:-1] + 1))
                got = [digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            sizes.append(len(got))
            digests += got
        flat = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
        counts = np.array(sizes, np.int64)
        cut = np.concatenate(([0], np.cumsum(counts)))
        out = {"hi": fingerprint_bits(flat[:, 0], counts).view(np.int64), "lo": fingerprint_bits(flat[:, 1], counts).view(np.int64)}
        n = np.array([len(np.unique(flat[x:y, 0])) for x, y in zip(cut[:-1], cut[1:], strict=True)], np.int64)
        yield {"doc_id": C.column(batch, "doc_id"), **out, "n": n}

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, hi long, lo long, n long")


def rotated(hi: np.ndarray, lo: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits turned left by ``by``."""
    if by >= 64:
        hi, lo, by = lo, hi, by - 64
    if not by:
        return hi, lo
    up, down = np.uint64(by), np.uint64(64 - by)
    return hi << up | lo >> down, lo << up | hi >> down


def _fold(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    links.clear()
    n = len(root)
    return _roots(n, np.concatenate((a, np.arange(n))), np.concatenate((b, root)))


def near_forest(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, flip: np.ndarray, width: int, dealt: int, radius: int, similarity: float, ring: list[tuple[int, int]], at: int) -> np.ndarray:
    """The least index that each row of a bucket links to.  The rows are turned so that the bucket's segment comes first.

    Rows with ``flip`` are probes: they look for rows whose first segment differs from theirs in that one dealt bit.
    """
    total = len(hi)
    key = (hi >> np.uint64(64 - width)).astype(np.int64) ^ flip
    home, probe = np.flatnonzero(flip == 0), np.flatnonzero(flip != 0)
    home, probe = (x[np.lexsort((n[x], key[x]))] for x in (home, probe))
    if not len(home):
        return np.arange(total)
    keys = key[home]
    widths = [ring[(at + k) % len(ring)][1] for k in range(len(ring))]
    chain = []  # (mask of the first bits of a row, most differences in them)
    for k in range(2, len(ring) + 1):
        if sum(widths[:k]) <= 64:
            chain.append((np.uint64(((1 << sum(widths[:k])) - 1) << (64 - sum(widths[:k]))), k * radius // len(ring)))
    root = np.arange(total)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def compare(x: np.ndarray, y: np.ndarray, own: bool) -> None:
        """Links between the rows x and y, each in ascending order of n."""
        nonlocal root, held
        step = max(1, min(256, CELLS // max(1, len(y))))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            j = i + 1 if own else np.searchsorted(n[y], math.ceil(similarity * n[part[0]] - 1e-9))
            rest = y[j : np.searchsorted(n[y], math.floor(n[part[-1]] / similarity + 1e-9), "right")]
            if not len(rest):
                continue
            differ = hi[part][:, None] ^ hi[rest][None, :]
            a, b = np.nonzero(np.bitwise_count(differ & chain[0][0]) <= chain[0][1])
            differ = differ[a, b]
            a, b = part[a], rest[b]
            for mask, most in chain[1:]:
                some = np.bitwise_count(differ & mask) <= most
                a, b, differ = a[some], b[some], differ[some]
            some = (np.bitwise_count(differ).astype(np.int64) + np.bitwise_count(lo[a] ^ lo[b]) <= radius) & (a != b)
            some &= np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            some &= root[a] != root[b]
            if some.any():
                links.append((a[some], b[some]))
                held += int(some.sum())
                if held > _HOLD:
                    root, held = _fold(root, links), 0

    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    tails = np.append(heads[1:], len(keys))
    place = {int(keys[h]): (h, t) for h, t in zip(heads, tails, strict=True)}
    for k, (h, t) in place.items():
        own = home[h:t]
        compare(own, own, True)
        for bit in range(width - dealt):
            if not k >> bit & 1 and (k | 1 << bit) in place:
                h2, t2 = place[k | 1 << bit]
                compare(own, home[h2:t2], False)
        lo_, hi_ = np.searchsorted(key[probe], [k, k + 1])
        if hi_ > lo_:
            compare(own, probe[lo_:hi_], False)
    return _fold(root, links) if links else root


def near_links(classes: DataFrame, dealt: int, radius: int, similarity: float) -> DataFrame:
    """(u, v): a forest that spans the links of each bucket; ``classes`` has hi, lo, n and rep.

    Each ring turns the bits, and its first ``dealt`` bits name the bucket; a row also goes where one of those bits that is
    0 would be 1, so a pair meets once a ring.
    """
    ring = ring_of(radius)
    schema = C.arrow_schema("ring int, bucket int, flip int, hi long, lo long, n long, rep long")

    def deal(batches):
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            n, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            for k, (start, width) in enumerate(ring):
                h, low = rotated(hi, lo, start)
                bucket = (h >> np.uint64(64 - dealt)).astype(np.int64)
                for bit in range(-1, dealt):
                    some = np.flatnonzero(bucket >> bit & 1 == 0) if bit >= 0 else np.arange(len(h))
                    to = bucket[some] | 1 << bit if bit >= 0 else bucket
                    flip = 1 << bit + width - dealt if bit >= 0 else 0
                    cols = [np.full(len(some), k), to, np.full(len(some), flip), h[some].view(np.int64), low[some].view(np.int64), n[some], rep[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    def run(table: pa.Table) -> pa.Table:
        at = table.column("ring")[0].as_py()
        hi, lo = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
        n, rep, flip = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "rep", "flip"))
        root = near_forest(hi, lo, n, flip, ring[at][1], dealt, radius, similarity, ring, at)
        own = np.flatnonzero(root != np.arange(len(root)))
        u, v = np.maximum(rep[own], rep[root[own]]), np.minimum(rep[own], rep[root[own]])
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=C.arrow_schema("u long, v long"))

    rows = classes.where("rep is not null").select("hi", "lo", "n", "rep").mapInArrow(deal, "ring int,bucket int,flip int,hi long,lo long,n long,rep long")
    return rows.groupBy("ring", "bucket").applyInArrow(run, "u long,v long").where("u <> v").distinct()


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable by links between wide fingerprints, for every row.

    Links are fingerprints within ``radius_for(similarity)`` bits whose numbers of distinct shingles agree to ``similarity``.
    """
    marked = C.written(wide_fingerprints(docs, shingle))
    classes = C.written(marked.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep")))
    dealt = min(9, max(3, C.bucket_count(docs).bit_length() - 3))
    joined = components(near_links(classes, dealt, radius_for(similarity), similarity))
    own = C.written(classes.join(joined, classes.rep == joined.node, "left").select("hi", "lo", "n", F.coalesce("component", "rep").alias("component_id")))
    return marked.join(own, ["hi", "lo", "n"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near group; rows with a null doc_id stay."""
    gone = near_groups(docs, similarity, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("_parchment_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_parchment_id"), "left_anti").select(*docs.columns)
