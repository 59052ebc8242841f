import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from parchment.llm import simhash_dedup as sim
from parchment.llm import substring_dedup as sub
from parchment.llm import suffix_dedup as suf
from tests.llm import cases


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute_words(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_difference_cover_has_every_difference():
    assert {(a - b) % sub.PERIOD for a in sub.COVER for b in sub.COVER} == set(range(sub.PERIOD))


def test_windows_against_brute_force(spark):
    rows = list(enumerate(cases.texts()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub.kept_words(sub.substring_dedup(cases.documents(spark))).collect()}
    assert got == brute_words(rows)
    assert sum(x[1] for x in got.values()) > 500


def test_windows_odd_cases(spark):
    assert sub.kept_words(sub.substring_dedup(cases.empty(spark))).count() == 0
    text = cases.texts()[6]
    rows = [(None, text), (5, text), (5, text), (9, text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in sub.kept_words(sub.substring_dedup(cases.documents(spark, rows))).collect())
    assert got == [("5", 0), ("5", 0), ("9", 400), ("None", 0)]


def brute_bytes(rows, n=400):
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [suf.CROWD, 0])
def test_suffixes_against_brute_force(spark, monkeypatch, crowd):
    rows = [(i, t) for i, t in enumerate(cases.texts()) if i != 14]
    monkeypatch.setattr(suf, "CROWD", crowd)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suf.kept_bytes(suf.suffix_dedup(cases.documents(spark, rows))).collect()}
    assert got == brute_bytes(rows)
    assert sum(x[1] for x in got.values()) > 5000


def test_radix_passes_keep_only_repeated_suffixes():
    from parchment.llm import _common as C

    data = np.frombuffer(b"abcdefgh" * 3 + b"zzabcdefghab", np.uint8)
    at = np.arange(len(data) - 10 + 1)
    hit = suf.radix_groups(np.zeros(len(at), np.int64), at, C.byte_prefix(data, 17), 10, 4)
    seen = Counter(data[k : k + 10].tobytes() for k in at)
    assert sorted(at[hit]) == [k for k in at if seen[data[k : k + 10].tobytes()] > 1]


def test_suffixes_odd_cases(spark):
    assert suf.kept_bytes(suf.suffix_dedup(cases.empty(spark))).count() == 0
    rows = [(None, "q" * 100 + "r" * 500), (1, "q" * 100 + "r" * 500)]
    got = {r.doc_id: r.n_removed for r in suf.kept_bytes(suf.suffix_dedup(cases.documents(spark, rows))).collect()}
    assert got == {None: 0, 1: 500}  # only the run of r repeats in itself


def brute_fingerprint(t, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=2):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_simhash_against_brute_force(spark):
    rows = list(enumerate(cases.texts()))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sim.simhash_groups(cases.documents(spark)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert got[7][1] == 6


@pytest.mark.parametrize("probe_above", [sim.PROBE_ABOVE, 0])
def test_chains_find_every_link_in_crowded_fingerprints(monkeypatch, probe_above):
    monkeypatch.setattr(sim, "PROBE_ABOVE", probe_above)
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 4, dtype=np.int64).astype(np.uint64)
    fp = np.unique(np.concatenate([[c ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in r.integers(0, 64, (60, 2))] for c in centre]).astype(np.uint64))
    got = set()
    for ring in range(3):
        s, w = sim.SEGMENTS[ring]
        seg = fp >> np.uint64(s) & np.uint64((1 << w) - 1)
        for v in np.unique(seg):
            own = np.flatnonzero(seg == v)
            a, b = sim.chain_links(fp[own], ring)
            got |= {tuple(sorted((int(own[x]), int(own[y])))) for x, y in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bin(int(fp[i] ^ fp[j])).count("1") <= 2}
    assert got == want and len(want) > 500


# --- near copies ---------------------------------------------------------------------------------------------------


def brute_wide(t, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh3_128_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(128) if h and 2 * sum(x >> b & 1 for x in h) > len(h)), len({x >> 64 for x in h})


def edited(r, text, share):
    return " ".join(w if r.random() > share else "".join(r.choice("vwxyz") for _ in range(5)) for w in text.split())


def near_rows():
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6))) for _ in range(n))
    rows = [(i, t) for i, t in enumerate(cases.texts()) if i != 14]
    for k in range(40):
        base = prose(r.randint(60, 500))
        rows += [(1000 + 10 * k + j, edited(r, base, r.choice((0.0, 0.004, 0.01, 0.02, 0.03, 0.06)))) for j in range(6)]
    return rows


def test_near_groups_against_brute_force(spark):
    rows = near_rows()
    fps = {i: brute_wide(t) for i, t in rows}
    radius = sim.radius_for(0.8)
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(fps)
    for k, i in enumerate(order):
        for j in order[:k]:
            (a, n), (b, m) = fps[i], fps[j]
            if (a ^ b).bit_count() <= radius and min(n, m) >= 0.8 * max(n, m):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in sim.near_groups(cases.documents(spark, rows)).collect()}
    assert got == {i: find(i) for i in fps}
    assert sum(v != i for i, v in got.items()) > 60


def test_near_copies_are_found(spark):
    rows = near_rows()[20:]
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in rows}
    close, far = [], []
    for i in sets:
        for j in sets:
            if i < j:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.8:
                    close.append((i, j))
                elif s < 0.1:
                    far.append((i, j))
    got = {r.doc_id: r.component_id for r in sim.near_groups(cases.documents(spark, rows)).collect()}
    assert len(close) > 100 and sum(got[i] == got[j] for i, j in close) >= 0.9 * len(close)
    assert not any(got[i] == got[j] for i, j in far)


@pytest.mark.parametrize("dealt", [3, 9])
def test_each_pair_meets_in_some_ring(spark, dealt):
    r = np.random.default_rng(5)
    base = [int.from_bytes(r.bytes(16)) for _ in range(20)]
    rows = {}
    for b in base:
        for _ in range(8):
            x = b
            for bit in r.choice(128, r.integers(0, 22), replace=False):
                x ^= 1 << int(bit)
            rows[x] = len(rows) + 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1), 100, i) for x, i in rows.items()], "hi long, lo long, n long, rep long")
    parent = {i: i for i in rows.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for x, i in rows.items() for y, j in rows.items() if i < j and (x ^ y).bit_count() <= 25]
    for u, v in [(r.u, r.v) for r in sim.near_links(df, dealt, 25, 0.8).collect()]:
        assert u > v
        parent[find(u)] = find(v)
    assert pairs and all(find(i) == find(j) for i, j in pairs)
    groups = {}
    for i in rows.values():
        groups.setdefault(find(i), []).append(i)
    close = {i: set() for i in rows.values()}
    for i, j in pairs:
        close[i].add(j)
        close[j].add(i)
    for own in groups.values():  # nothing is linked but by such pairs
        seen, todo = {own[0]}, [own[0]]
        while todo:
            for y in close[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert seen == set(own)


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(0, 60)] + [(200, 100), (150, 100)], "u long, v long")
    got = {r.node: r.component for r in sim.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 200: 100, 150: 100}


def test_simhash_odd_cases(spark):
    assert sim.simhash_groups(cases.empty(spark)).count() == 0
    got = sorted((str(r.doc_id), r.component_id) for r in sim.simhash_groups(cases.documents(spark, [(None, "a b c d"), (4, "a b c d"), (4, "A b c d"), (2, "A B C D")])).collect())
    assert got == [("2", 2), ("4", 2), ("4", 2), ("None", 2)]
    kept = sim.one_of_each(cases.documents(spark, [(None, "a b c d"), (4, "a b c d"), (2, "A B C D"), (7, "w x y z")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "None"] and kept.columns == cases.documents(spark, []).columns
