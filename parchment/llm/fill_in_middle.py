"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put in another order.

A cut after k code points is a *select* over the UTF-8 bytes: the end of the k-th unit.  The bytes of a chunk are viewed
as ``uint64`` words; the bytes that end a unit are marked by shifts and masks, eight at a time; ``bitwise_count`` of the
marks and their cumulative sum rank the words, a search finds the word of a cut, and a table of 256 mark patterns gives the
place in it.  No text is decoded.

Defined cases: a null or empty text is ``plain``; a null id hashes as no digits; repeated rows are returned each; other
columns are ignored; a text that holds one of the marks is left plain, so that every output can be parted again.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: Documents in a hundred that are transformed, and of those in suffix-first order.
RATE, SPM_RATE = 90, 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

_ONES = np.uint64(0x0101010101010101)


def _select_table() -> np.ndarray:
    """``table[marks, r]``: the place of the r-th set bit (from 0) in a byte of marks."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    table = np.zeros((256, 8), np.int64)
    pattern, place = np.nonzero(bits)
    table[pattern, (np.cumsum(bits, axis=1) - 1)[pattern, place]] = place
    return table


_SELECT = _select_table()


class UnitEnds:
    """Rank and select over the ends of the code points of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        words = np.zeros(len(data) // 8 + 1, "<u8")
        words.view(np.uint8)[: len(data)] = data
        going_on = (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES  # bytes 10xxxxxx
        after = np.append(going_on[1:], np.uint64(0))
        ends = ~((going_on >> np.uint64(8)) | (after << np.uint64(56))) & _ONES  # the following byte starts a unit
        spare = np.zeros(len(words) * 8, np.uint8)
        spare[: len(data)] = 1
        self.ends = ends & spare.view("<u8")
        self.total = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends).astype(np.int64))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end in the first ``at`` bytes."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        held = np.append(self.ends, np.uint64(0))[word] & below
        return self.total[np.minimum(word, len(self.ends))] + np.bitwise_count(held).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Bytes up to the end of the k-th unit (k from 1; 0 gives 0)."""
        word = np.minimum(np.searchsorted(self.total, np.maximum(k, 1), "left"), len(self.ends)) - 1
        marks = ((self.ends[word] * np.uint64(0x0102040810204080)) >> np.uint64(56)).astype(np.int64)  # bit i: byte i ends a unit
        end = word * 8 + _SELECT[marks, np.clip(k - self.total[word] - 1, 0, 7)] + 1
        return np.where(k > 0, end, 0)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits from the id alone."""
    h = hashlib.sha256(b"1:%s" % (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(h[a : a + 4], "big") for a in (0, 4, 8, 12))


def arrange(text: bytes, form: str, a: int, b: int) -> bytes:
    if form == PLAIN:
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == PSM else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text from an output and its form."""
    if form == PLAIN:
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = head[3:].split(SUFFIX if form == PSM else PREFIX, 1)
    return first + middle + second if form == PSM else second + middle + first


def _cut(batch, data, off):
    """Per document of a chunk: id, code points, form, cuts in units, and the output's bytes."""
    ids, raw, edges = C.column(batch, "doc_id").to_pylist(), data.tobytes(), off.tolist()
    texts = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    units = UnitEnds(data)
    base = units.rank(off)
    n = np.diff(base)
    h = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    start, stop = (units.select(base[:-1] + cuts[:, k]) - off[:-1] for k in (0, 1))
    forms = [
        PLAIN if not t or r % 100 >= RATE or PREFIX in t or SUFFIX in t or MIDDLE in t else SPM if s % 100 < SPM_RATE else PSM
        for t, r, s in zip(texts, h[:, 2].tolist(), h[:, 3].tolist(), strict=True)
    ]
    # a cut after no unit of its document is the document's start
    a, b = np.where(cuts[:, 0] > 0, start, 0).tolist(), np.where(cuts[:, 1] > 0, stop, 0).tolist()
    outputs = [arrange(t, f, x, y) for t, f, x, y in zip(texts, forms, a, b, strict=True)]
    shown = [f != PLAIN for f in forms]
    prefix = [c if s else None for c, s in zip(cuts[:, 0].tolist(), shown, strict=True)]
    middle = [c if s else None for c, s in zip((cuts[:, 1] - cuts[:, 0]).tolist(), shown, strict=True)]
    return {"doc_id": ids, "n": n, "form": forms, "prefix_chars": prefix, "middle_chars": middle}, outputs


def _source(docs: DataFrame) -> DataFrame:
    C.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def transform(docs: DataFrame) -> DataFrame:
    """One row per document with its transformed text: OUTPUT."""

    def run(batch, data, off):
        row, outputs = _cut(batch, data, off)
        yield row | {"output": [o.decode() for o in outputs]}

    return C.map_arrow(_source(docs), run, OUTPUT)


def digests(docs: DataFrame) -> DataFrame:
    """As ``transform`` with digests of the output and of the text that is restored from it: DIGEST."""

    def run(batch, data, off):
        row, outputs = _cut(batch, data, off)
        yield row | {
            "output_sha256": [hashlib.sha256(o).hexdigest() for o in outputs],
            "restored_sha256": [hashlib.sha256(restore(o, f)).hexdigest() for o, f in zip(outputs, row["form"], strict=True)],
        }

    return C.map_arrow(_source(docs), run, DIGEST)
