import re

import pytest

from parchment.functions.stems import stem
from parchment.operators import questions, retrieval

#: From the published sample vocabulary of the rules.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consols consol consonant conson consort consort
consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(("words", "want"), [
    ("motion motions", "motion"), ("moved moving moves move", "move"), ("generate generates generating", "generat"), ("skies sky", "sky"), ("hopping hopped", "hop"), ("hoping hoped hope", "hope"), ("ties tie", "tie"), ("cries cry cried", "cri"),
    ("rationally rational", "ration"), ("happily happy", "happili happi"), ("exceed", "exceed"), ("say", "say"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("bed", "bed"), ("feed", "feed"), ("agreed", "agre"), ("luxuriating", "luxuri"),
])
def test_rules(words, want):
    assert {stem(w) for w in words.split()} == set(want.split())


def test_stemmed_ranking_against_brute_force(spark):
    lines = ["The nation and its nations relate to things", "relating nations", "a thing handed to hands", "nothing here", "inventions inventing inventive", ""]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[0])], "doc_id long, text string")
    got = {(r.doc_id, r.ordinal): r.score for r in questions.ranked_by_stem(questions.inverted_index(retrieval.passages(docs)), questions.STEMMED).collect()}
    stems = {stem(t) for t in questions.STEMMED}
    want = {}
    for d, ls in ((1, lines), (2, lines[:1])):
        for k, x in enumerate(ls):
            hit = [s for s in map(stem, re.findall("[a-z0-9]+", x.lower())) if s in stems]
            if hit:
                want[d, k] = (len(hit) / (len(hit) + 10) + len(set(hit))) / (len(stems) + 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
