import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parchment.llm import token_alignment as ta
from tests.llm import cases

PATHS = ta.default_paths()
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé'sl 3.,!\n\t \x1c\x85\xa0 日<|>")), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ta.tokenizers(*PATHS).encode_a([text])[0], "<u4").tolist() == A.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé'sl 3.,!\n\t \x1c\x85\xa0 日▁<|>")), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text_by_b(text):
    if "▁" in text:  # not given back as it stands, so encoded whole
        part = ta.Part(ta.Pieces(ta.tokenizers(*PATHS)))
        assert part.documents([text])["n_a"].tolist() == [0]
    else:
        text += "."  # a last space alone isn't given back, so such a text is encoded whole
        assert np.frombuffer(ta.tokenizers(*PATHS).encode_b([text])[0], "<u4").tolist() == B.encode(text)


def test_a_piece_is_encoded_once_by_either_tokenizer(monkeypatch):
    asked = []
    for name in ("ids_a", "ids_b"):
        monkeypatch.setattr(ta.Tokenizers, name, lambda self, pieces, f=getattr(ta.Tokenizers, name), name=name: asked.extend((name, p) for p in pieces) or f(self, pieces))
    known = ta.Pieces(ta.tokenizers(*PATHS))
    for _ in range(2):  # two parts, with odd texts among others
        part = ta.Part(known)
        for texts in (["one two one", "three  spaced", "", "mark ▁ of one"], ["two four", " one", "one two one"]):
            part.documents(texts)
        totals = part.totals()
        assert totals["sums"].sum() == totals["links"].size + (np.repeat(part.times, totals["width"]) - 1).sum() and (totals["width"] >= 0).all()
    assert len(asked) == len(set(asked)) and ("ids_b", "two") in asked


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(ta, "MEMO", 20)
    for k in range(20):
        known = ta.known_pieces(PATHS)
        ta.Part(known).documents([" ".join(f"word{k}x{j}" for j in range(15))])
        assert len(known.text) <= 20 + 15
    monkeypatch.setattr(ta, "MEMO_CHARS", 5)
    assert ta.known_pieces(PATHS) is not known


def brute(rows):
    """All overlapping token pairs by their byte ranges, without windows."""
    letters = ta.byte_of_letter()
    vocabulary = {i: t for t, i in A.get_vocab().items()}
    bytes_a = lambda i: bytes(letters[c] for c in vocabulary[i])
    bytes_b = lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    documents, counts = [], Counter()
    for i, t in rows:
        a = A.encode(" " + (t or ""), add_special_tokens=False).ids
        b = B.encode(t or "")
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        a, b = spans(a, bytes_a), spans(b, bytes_b)
        links, k = [], 0
        for s, e, x in a:
            while k and b[k - 1][1] > s:
                k -= 1
            while k < len(b) and b[k][0] < e:
                if b[k][1] > s:
                    links.append((x, b[k][2]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        parts, start = [], 0
        for cut in cuts:
            parts.append(",".join(str(x) for s, e, x in a if start <= s and e <= cut) + "|" + ",".join(str(x) for s, e, x in b if start <= s and e <= cut))
            start = cut
        documents.append((i, len(a), len(b), len(cuts), links, ";".join(parts)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if na else "", text) for i, na, nb, g, links, text in documents]


@pytest.mark.parametrize("part_bytes", [300, 1 << 24])
def test_against_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(ta, "PART_BYTES", part_bytes)
    monkeypatch.setattr(ta.C, "CHUNK_BYTES", 2000)
    short = [t if t is None or len(t) < 3000 else t[:3000] for t in cases.texts()]
    odd = ["two  spaces   three", " leading", "trailing ", "tab\tand\n\nlines \n x", "mark ▁ of B", "</s><s><unk><|endoftext|>", "café don't \U0001f600\U0001f680 123456 naïve", "\x00 nul", "　wide", "x" * 500]
    rows = [*enumerate(short + odd), (None, "null id"), (3, "again"), (3, "again")]
    got = ta.align(cases.documents(spark, rows).repartition(3), with_groups=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert sum(r.n_a == 0 for r in got) >= 3


def test_no_documents(spark):
    assert ta.align(cases.empty(spark)).collect() == []
