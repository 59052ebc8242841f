"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE read by ``tokenizers``, B a SentencePiece model.  Neither joins a space to what stands before
it, unless that is white space too: there a text is cut into *pieces*, most of them one word, which have the same ids alone
as in their text, and both sides' tokens end at every cut.  A piece is encoded and aligned once while it stays in a worker's
memo: its groups, and its links by the union of both sides' ends, worked out for all new pieces of a chunk.  A text with a
piece that either side doesn't give back byte for byte is encoded whole, as one piece.

Counts are made in three steps.  A task numbers the pieces of some ``PART_BYTES`` of text and writes, per document, the
numbers of its pieces, and per part the id pairs of its pieces with their sums.  Sums are added up over all parts; each part
gets the totals of its own pairs back and adds them up by piece; documents then read them by number.  What is shuffled is a
row per part and pair, not per link.

Defined cases: a text that is null, empty, or that either tokenizer doesn't give back byte for byte has no tokens; a null
id and repeated rows are returned each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Text whose pieces share one numbering; bounds a part's rows.
PART_BYTES = 16 << 20
#: Pieces, and their characters, that are kept; beyond either the memo starts anew at the next part, so a worker's memory is bounded.
MEMO = 300_000
MEMO_CHARS = 16 << 20
_JOIN = 128

PASS = "part long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, groups array<string>, held array<int>, places binary, width array<int>, links array<int>, pairs array<long>, sums array<long>"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """The letters by which a byte-level BPE writes bytes: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Tokenizers:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, added = byte_of_letter(), self.a.get_added_tokens_decoder()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in added else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.space_a = self._shape(self.bytes_a)
        self.length_b, self.space_b = self._shape(self.bytes_b)
        # an id's decimal digits with what follows it: within a side, at a side's end, at a group's end, at a piece's end
        self.text_a, self.text_b = (np.array([b"%d%s" % (i, after) for after in afters for i in range(n)], object) for n, afters in ((len(self.bytes_a), (b",", b"|")), (len(self.bytes_b), (b",", b";", b""))))

    @staticmethod
    def _shape(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(x) for x in table], np.int64), np.array([x[:1] == b" " for x in table])

    @staticmethod
    def pieces(text: str) -> list[str]:
        """``' ' + text`` cut before spaces that don't follow white space, each without its first space."""
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:
            if _goes_on(out[-1]):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _whole_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _whole_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.b.encode(texts, num_threads=1)] if texts else []

    @staticmethod
    def _ids(pieces: list[str], whole, space: np.ndarray) -> list[bytes]:
        """Ids of pieces: single words are encoded many at a time and parted before space-marked tokens."""
        got = {}
        plain = [w for w in pieces if w and " " not in w and "▁" not in w and not w[0].isspace() and not w[-1].isspace()]
        groups = [plain[k : k + _JOIN] for k in range(0, len(plain), _JOIN)]
        for group, ids in zip(groups, whole([" ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(space[ids]) * 4
            if len(starts) == len(group):
                raw, cuts = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
                got.update(zip(group, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        rest = [w for w in pieces if w not in got]
        got.update(zip(rest, [x.tobytes() for x in whole(rest)], strict=True))
        return [got[w] for w in pieces]

    def ids_a(self, pieces: list[str]) -> list[bytes]:
        """Ids of ``' ' + piece`` by A for different pieces, as little-endian unsigned 32-bit integers."""
        return self._ids(pieces, self._whole_a, self.space_a)

    def ids_b(self, pieces: list[str]) -> list[bytes]:
        """Those of each piece by B, which adds the space."""
        return self._ids(pieces, self._whole_b, self.space_b)

    def encode_a(self, texts: list[str]) -> list[bytes]:
        """Ids of ``' ' + text`` by A, put together from those of its pieces."""
        return self._put_together(texts, self.ids_a)

    def encode_b(self, texts: list[str]) -> list[bytes]:
        return self._put_together(texts, self.ids_b)

    def _put_together(self, texts: list[str], ids_of) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*split))
        have = dict(zip(new, ids_of(new), strict=True))
        return [b"".join([have[w] for w in s]) for s in split]


def _goes_on(piece: str) -> bool:
    """Whether a space that follows belongs to the piece."""
    return not piece or piece[-1].isspace()


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(itemgetter(*ids)(table)) if len(ids) > 1 else table[ids[0]] if ids else b""


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of many ranges."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def last_of(groups: np.ndarray) -> np.ndarray:
    return np.append(groups[1:] != groups[:-1], True) if len(groups) else np.zeros(0, bool)


class Numbers(dict):
    """Numbers pieces in the order in which they are asked for; ``new`` has those not learned yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Pieces:
    """The pieces that a worker knows, with their alignments."""

    def __init__(self, tokens: Tokenizers):
        self.tokens, self.chars = tokens, 0
        self.number = Numbers()
        self.text: list[bytes] = []
        self.n_a, self.n_b, self.groups, self.links = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)  # of links, piece by piece
        self.wrong, self.goes_on = np.zeros(0, bool), np.zeros(0, bool)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        new, self.number.new = self.number.new, []
        if new:
            self._learn(new)
        return out

    @staticmethod
    def _given_back(ids: list[bytes], table: list[bytes], length: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the bytes of the ids are those wanted, piece by piece."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        cuts = np.concatenate(([0], np.cumsum(length[flat])))[np.cumsum([0, *map(len, ids)]) // 4].tolist()
        raw = joined(table, flat.tolist())
        return np.array([raw[a:b] == w for a, b, w in zip(cuts[:-1], cuts[1:], want, strict=True)])

    def _learn(self, new: list[str]) -> None:
        t = self.tokens
        ids_a, ids_b, want = t.ids_a(new), t.ids_b(new), [b" " + p.encode() for p in new]
        right = self._given_back(ids_a, t.bytes_a, t.length_a, want) & self._given_back(ids_b, t.bytes_b, t.length_b, want)
        kept = np.flatnonzero(right).tolist()
        n_a, n_b, groups, links = (np.zeros(len(new), np.int64) for _ in range(4))
        text = [b""] * len(new)
        if kept:
            x, y = (np.frombuffer(b"".join([ids[k] for k in kept]), "<u4") for ids in (ids_a, ids_b))
            n_a[kept], n_b[kept] = ([len(ids[k]) // 4 for k in kept] for ids in (ids_a, ids_b))
            groups[kept], links[kept], pairs, spelled = self._align(x, n_a[kept], y, n_b[kept])
            self.pairs = np.concatenate((self.pairs, pairs))
            for k, one in zip(kept, spelled, strict=True):
                text[k] = one
        self.text += text
        self.chars += sum(map(len, new))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(links)))
        for name, more in (("n_a", n_a), ("n_b", n_b), ("groups", groups), ("links", links), ("wrong", ~right), ("goes_on", np.array([_goes_on(p) for p in new]))):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def _align(self, x: np.ndarray, n_a: np.ndarray, y: np.ndarray, n_b: np.ndarray):
        """(groups, links, id pairs of links, text) of pieces laid end to end: a group ends where both sides do, a link where either does."""
        t = self.tokens
        end_x, end_y = np.cumsum(t.length_a[x]), np.cumsum(t.length_b[y])
        at = np.zeros(int(end_x[-1]) + 1, np.int8)
        at[end_x] = 1
        at[end_y] += 2
        either, shared = np.flatnonzero(at), np.flatnonzero(at == 3)
        ends_x, ends_y = at[either] != 2, at[either] > 1
        of_a, of_b = np.cumsum(ends_x) - ends_x, np.cumsum(ends_y) - ends_y  # the ids that a link's last byte lies in
        pairs = x[of_a].astype(np.int64) << 32 | y[of_b].astype(np.int64)
        piece_end = end_x[np.cumsum(n_a) - 1]
        links, groups = (np.diff(np.searchsorted(places, piece_end, "right"), prepend=0) for places in (either, shared))
        # the text: sides of a group in turn, each id with what follows it
        of_x, of_y = np.searchsorted(shared, end_x), np.searchsorted(shared, end_y)
        many_x, many_y = np.bincount(of_x, minlength=len(shared)), np.bincount(of_y, minlength=len(shared))
        spelled = np.empty(len(x) + len(y), object)
        spelled[np.arange(len(x)) + (np.cumsum(many_y) - many_y)[of_x]] = t.text_a[x + last_of(of_x) * len(t.bytes_a)]
        closes = np.zeros(len(y), np.int64)
        closes[np.cumsum(n_b) - 1] = 1
        spelled[np.arange(len(y)) + np.cumsum(many_x)[of_y]] = t.text_b[y + (last_of(of_y) + closes) * len(t.bytes_b)]
        ids, cuts = spelled.tolist(), [0, *np.cumsum(n_a + n_b).tolist()]
        return groups, links, pairs, [b"".join(ids[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Part:
    """The pieces of a part of the text, numbered in the order in which it first has them, and how often it does."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.bytes = pieces, 0
        self.place = np.zeros(0, np.int64)  # one more than a piece's number in the part, 0 where it isn't in it
        self.own = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def places(self, w: np.ndarray) -> np.ndarray:
        grown = len(self.pieces.text)
        self.place = np.concatenate((self.place, np.zeros(grown - len(self.place), np.int64)))
        new = np.unique(w[self.place[w] == 0])
        self.place[new] = len(self.own) + 1 + np.arange(len(new))
        self.own = np.concatenate((self.own, new))
        out = self.place[w] - 1
        times = np.bincount(out, minlength=len(self.own))
        times[: len(self.times)] += self.times
        self.times = times
        return out

    def documents(self, texts: list[str]) -> dict:
        """Counts, groups and numbers of pieces of each of some texts."""
        known, n = self.pieces, len(texts)
        split = [t.split(" ") for t in texts]
        count = np.array(list(map(len, split)), np.int64)
        w = known.numbers(list(chain.from_iterable(split)))
        for odd, cut in (("goes_on", known.tokens.pieces), ("wrong", lambda text: [text])):
            recut = np.unique(np.repeat(np.arange(n), count)[getattr(known, odd)[w]])
            if len(recut):
                each = np.split(w, np.cumsum(count)[:-1])
                for i in recut.tolist():
                    each[i] = known.numbers(cut(texts[i]))
                w, count = np.concatenate(each), np.array(list(map(len, each)), np.int64)
        first = np.cumsum(count) - count
        edges, order = [*first.tolist(), len(w)], w.tolist()
        per_doc = lambda x: np.add.reduceat(x[w], first) if n else np.zeros(0, np.int64)  # noqa: E731  every text has a piece
        return {
            "n_a": per_doc(known.n_a), "n_b": per_doc(known.n_b), "n_groups": per_doc(known.groups), "n_links": per_doc(known.links),
            "groups": [b";".join(itemgetter(*order[i:j])(known.text)) if j - i > 1 else known.text[order[i]] for i, j in zip(edges[:-1], edges[1:], strict=True)],
            "held": count, "places": C.planes(self.places(w), 4),
        }

    def totals(self) -> dict:
        """The part's id pairs with their sums, and which of them each of its pieces has."""
        known, width = self.pieces, self.pieces.links[self.own]
        pairs, links = np.unique(known.pairs[ranges(known.ends[self.own], width)], return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, links, np.repeat(self.times, width))
        return {"pairs": pairs, "sums": sums, "links": links, "width": width}


@lru_cache(maxsize=1)
def _known(a_path: str, b_path: str) -> list[Pieces]:
    """What a worker has learned so far; one item, replaced when it has grown too large."""
    return [Pieces(tokenizers(a_path, b_path))]


def known_pieces(paths: tuple[str, str]) -> Pieces:
    held = _known(*paths)
    if len(held[0].text) > MEMO or held[0].chars > MEMO_CHARS:
        held[0] = Pieces(held[0].tokens)
    return held[0]


def _parts(docs: DataFrame, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    C.tune(docs.sparkSession)
    schema = C.arrow_schema(PASS)

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        part = Part(known_pieces(paths))
        for batch, data, off in C.chunks(batches):
            if part.bytes >= PART_BYTES:
                yield row(part=number, **part.totals())
                part, number = Part(known_pieces(paths)), number + 1
            raw, edges = data.tobytes(), off.tolist()
            got = part.documents([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            part.bytes += len(data)
            groups = got.pop("groups")
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            yield row(part=number, doc_id=C.column(batch, "doc_id").to_pylist(), digest=digest, **({"groups": [g.decode() for g in groups]} if with_groups else {}), **got)
        yield row(part=number, **part.totals())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PASS.replace(", ", ","))


def pair_counts(parts: DataFrame) -> DataFrame:
    """Corpus-wide links of each id pair, and whether no other A id has more with that B id: (pair, links, best)."""
    sums = parts.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "sums")).alias("x")).select("x.pairs", "x.sums").groupBy(F.col("pairs").alias("pair")).agg(F.sum("sums").alias("links"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = sums.groupBy(b.alias("b")).agg(F.max("links").alias("most"))  # a row an id of B's vocabulary
    return sums.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


_PIECE_TOTALS = "part long, best array<long>, total array<long>"


def _flat(batch, name: str) -> np.ndarray:
    return C.column(batch, name).flatten().to_numpy(zero_copy_only=False)


def _piece_totals(batches):
    """Of each piece of a part: its links that are best, and the sum of their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            width, value = _flat(one, "width").astype(np.int64), _flat(one, "totals")[_flat(one, "links")]
            upto = np.concatenate(([0], np.cumsum(width)))
            best, total = (np.diff(np.concatenate(([0], np.cumsum(x)))[upto]) for x in (value & 1, value >> 1))
            yield pa.RecordBatch.from_arrays([C.column(one, "part"), *(C.list_array(x, np.array([len(x)])) for x in (best, total))], names=["part", "best", "total"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """One row per document: REPORT, and with ``with_groups`` the groups as text (``a1,a2|b1;a3|b2,b3``)."""
    parts = C.written(_parts(docs, paths or default_paths(), with_groups))
    value = F.shiftleft("links", 1) + F.col("best").cast("long")
    listed = parts.where("pairs is not null").select("part", F.posexplode("pairs").alias("no", "pair"))
    back = listed.join(pair_counts(parts).select("pair", value.alias("value")), "pair").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("no", "value"))).alias("x"))
    totals = back.select("part", F.transform("x", lambda x: x["value"]).alias("totals"))
    of_pieces = parts.where("pairs is not null").select("part", "width", "links").join(totals, "part").mapInArrow(_piece_totals, _PIECE_TOTALS.replace(", ", ","))
    joined_back = parts.where("doc_id is not null").drop("pairs", "sums", "width", "links").join(of_pieces, "part", "left")
    ddl = REPORT + ", groups string" * with_groups
    schema = C.arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                held = _flat(one, "held").astype(np.int64)
                first = np.cumsum(held) - held
                places = C.from_planes(C.column(one, "places")[0].as_py(), int(held.sum()), 4).astype(np.int64)
                best, total = _flat(one, "best"), _flat(one, "total")
                best, total = (np.add.reduceat(x[places], first) if len(x) else np.zeros(len(held), np.int64) for x in (best, total))
                cols = {n: C.column(one, n).flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if with_groups else []))}
                cols |= {"n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": C.column(one, "digest").flatten()}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

    return joined_back.mapInArrow(run, ddl.replace(", ", ","))
