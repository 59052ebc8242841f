"""Statistics of whole texts, for the rules and the quality classifier: one vectorised pass over chunks.

All counts are per document and over all of it; a null text counts as empty and has zeros everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "le la les de des du et en un une que qui pour dans est par sur au ne pas il elle avec ce se "
    "der die das und ist den von zu mit sich auf für ein eine dem nicht als auch es im werden bei oder "
    "el los las del que y en un una por con para es se su al lo como más pero sus"
).split()

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bars", "n_bangs", "n_stop", "n_bytes", "n_stutter", "n_caps_words", "n_marked_words")
DDL = ", ".join(f"{c} long" for c in COLUMNS)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _stop_hashes() -> np.ndarray:
    raw = " ".join(dict.fromkeys(STOP_WORDS)).encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = C.word_spans(data, np.array([0, len(data)]))
    return np.sort(C.word_hashes(data, starts, ends, 21))


def _within(total: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(total)))
    return c[off[1:]] - c[off[:-1]]


def document_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(off) - 1
    starts, ends, first = C.word_spans(data, off)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(docs), n_words)
    solid = ~C.SPACE[data]
    out = {"n_words": n_words, "n_bytes": np.diff(off)}
    out["word_chars"] = _within(solid & (data & 0xC0 != 0x80), off)
    symbol = _SYMBOL[data]
    upper, letter = _UPPER[data], _LETTER[data]
    for name, mask in (("n_symbols", symbol), ("n_upper", upper), ("n_letters", letter), ("n_digits", _DIGIT[data]), ("n_bars", data == 0x7C), ("n_bangs", data == 0x21)):
        out[name] = _within(mask, off)
    # words: all capitals, or with a symbol inside
    at = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    cu, cl, cs = at(upper), at(letter), at(symbol)
    caps = (cu[ends] - cu[starts] == cl[ends] - cl[starts]) & (cu[ends] - cu[starts] >= 2)
    out["n_caps_words"] = np.bincount(doc[caps], minlength=docs)
    out["n_marked_words"] = np.bincount(doc[cs[ends] > cs[starts]], minlength=docs)
    words = C.word_hashes(_LOWER[data], starts, ends, 21)
    stop = _stop_hashes()
    out["n_stop"] = np.bincount(doc[stop[np.minimum(np.searchsorted(stop, words), len(stop) - 1)] == words], minlength=docs)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]) if len(words) else np.zeros(0, bool)
    out["n_stutter"] = np.bincount(doc[1:][same], minlength=docs)
    # words in windows found twice or more
    exact = C.byte_prefix(data, 22)
    salt = C.mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    begin = np.flatnonzero(np.arange(len(starts)) + REPEAT_WINDOW <= first[1:][doc]) if len(starts) else starts
    h = C.mix(C.span_hash(C.prefix_hash(C.span_hash(exact, starts, ends)), begin, begin + REPEAT_WINDOW) + salt[doc[begin]])
    order = np.argsort(h)
    s = h[order]
    again = np.zeros(len(h), bool)
    twice = s[1:] == s[:-1]
    again[order[1:][twice]] = True
    again[order[:-1][twice]] = True
    covered = C.cover(len(starts), begin[again], np.full(int(again.sum()), REPEAT_WINDOW))
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=docs)
    # lines with a word, and those equal to an earlier one
    heads = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1)))
    heads = heads[heads < len(data)]
    tails = np.append(heads[1:], len(data)) if len(heads) else heads
    tails = tails - (data[tails - 1] == 10) if len(heads) else tails
    line_doc = np.searchsorted(off, heads, "right") - 1
    cw = at(solid)
    some = cw[tails] > cw[heads]
    heads, tails, line_doc = heads[some], tails[some], line_doc[some]
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    h = C.mix(C.span_hash(exact, heads, tails) + salt[line_doc])
    s = np.argsort(h, kind="stable")
    late = s[1:][h[s][1:] == h[s][:-1]] if len(s) else s
    out["n_dup_lines"] = np.bincount(line_doc[late], minlength=docs)
    return out



def stats(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, COLUMNS and the long columns ``carry`` for every row."""
    C.tune(docs.sparkSession)

    def one(batch, data, off):
        yield {"doc_id": C.column(batch, "doc_id"), **document_stats(data, off), **{c: C.column(batch, c) for c in carry}}

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry), one, ", ".join(["doc_id long", DDL, *(f"{c} long" for c in carry)]))
