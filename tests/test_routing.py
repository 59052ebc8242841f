"""The whole retrieval against a walk over all passages in plain Python."""

import re
from datetime import timezone

import pytest

from parchment.functions.periods import parse_period
from parchment.functions.stems import stem
from parchment.operators import questions, routing, text_index
from parchment.sources.scratch import folder
from tests.oracles import SMALL


@pytest.fixture(scope="module")
def held(spark):
    docs = routing.archive(spark, SMALL)
    index = text_index.KeptIndex(spark, folder(spark, "routing"), True, text_index.headed_passages, buckets=4)
    index.upkeep(docs.select("doc_id", "text"))
    rows = {r.doc_id: r for r in docs.collect()}
    passages = {(r.doc_id, r.ordinal): r.content for r in text_index.headed_passages(docs).collect()}
    return index, docs, rows, passages


def ranks(passages, concepts, ids=None):
    """By counting the stems of every passage."""
    groups = [{stem(w) for w in c.split("|")} for c in concepts]
    out = []
    for (d, o), content in passages.items():
        if ids is not None and d not in ids:
            continue
        stems = [stem(w) for w in re.findall(r"[^\W_]+", content.lower())]
        tfs = [sum(s in g for s in stems) for g in groups]
        if any(tfs):
            tf = sum(tfs)
            out.append(((tf / (tf + 10) + sum(t > 0 for t in tfs)) / (len(groups) + 1), d, o))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))[:240]


def weight(row, asked, newest, now):
    kind, title, q = row.kind, row.title.lower(), asked.text.lower()
    members = {"directory": 2.6, "attendance": 1.8} if asked.members else {}
    current = {"guiding.constitution": 1.6, "guiding.bylaws": 1.45} if asked.focus == "current" else {}
    w = members.get(kind) or (0.55 if asked.members and kind.startswith("guiding.") else None) or current.get(kind) or (0.6 if kind in ("attendance", "directory") else 1)
    if asked.members and re.search("sheet|roster|email list|contact list|directory", title):
        w *= 1.6
    elif "constitution" in q and kind == "guiding.constitution" or re.search("bylaws?", q) and kind == "guiding.bylaws":
        w *= 1.35
    edition = "" if not kind.startswith("guiding.") else "latest" if newest[row.lineage] == row.doc_id else "older"
    if asked.focus == "current":
        w *= 0.35 if edition == "older" else 1
        if row.dated:
            years = (now.timestamp() - row.dated.replace(tzinfo=timezone.utc).timestamp()) / (365.25 * 86400)
            w *= 1.2 if years < 0.5 else 1.12 if years < 1.5 else 1.05 if years < 3 else 1
    return w, edition


def plain(held, question, now, asked):
    _, _, rows, passages = held
    stamp = lambda r: r.dated.replace(tzinfo=timezone.utc).timestamp() if r.dated else 0.0
    if asked.period:
        period = parse_period(question, now)
        dated = sorted((r for r in rows.values() if r.dated and r.text), key=lambda r: (-stamp(r), r.doc_id))
        inside = [r for r in dated if period.start.timestamp() <= stamp(r) < period.end.timestamp()]
        listed = (inside or dated[:6])[:40]
        ids = {r.doc_id for r in listed}
        best = ranks(passages, asked.concepts, ids) or ranks(passages, questions.BUSINESS, ids)
        out = []
        for r in listed:
            own = [(d, o) for _, d, o in best if d == r.doc_id] or sorted(k for k in passages if k[0] == r.doc_id and k[1] < 2)
            out += own[:2]
            if len(out) >= 14:
                break
        return out, not inside
    newest = {}
    for r in rows.values():
        if r.kind.startswith("guiding.") and (r.lineage not in newest or (stamp(r), r.session, -r.doc_id) > newest[r.lineage][0]):
            newest[r.lineage] = ((stamp(r), r.session, -r.doc_id), r.doc_id)
    newest = {k: d for k, (_, d) in newest.items()}
    scored = {(d, o): s * weight(rows[d], asked, newest, now)[0] for s, d, o in ranks(passages, asked.concepts)}
    lift = {}
    if asked.members:
        sheets = sorted((r for r in rows.values() if r.text and (r.kind == "directory" or r.kind == "attendance" and "sheet" in r.title.lower())), key=lambda r: (r.dated is None, -stamp(r), r.doc_id))[:8]
        ids = {r.doc_id for r in sheets}
        own = ranks(passages, asked.concepts, ids)[:8]
        lift |= {(d, o): 10 + s for s, d, o in own}
        if len(own) < 4:
            lift |= {k: 10.0 for k in passages if k[0] in ids and k[1] < 4 and k not in lift}
    if asked.votes:
        reg = [(-20 - sum(c.split("|")[0] in passages[k].lower() for c in asked.concepts), *k) for k in passages if "bill voting records" in rows[k[0]].title.lower() and passages[k]]
        lift |= {(d, o): -s for s, d, o in sorted(reg)[:3]}
    for k, s in lift.items():
        scored[k] = max(s, scored.get(k, 0))
    out, used = [], {}
    for (d, o), _ in sorted(scored.items(), key=lambda x: (-round(x[1], 9), x[0])):
        if used.get(d, 0) < (5 if asked.members else 3):
            used[d] = used.get(d, 0) + 1
            out.append((d, o))
    return out[:14], False


@pytest.mark.parametrize("question", [*routing.ASKED, "What did that heon bring in 2024?", "What happened in 2023?", "Who is currently in the Judiciary branch?", "What is the status of the zyxw resolution", "the of and"])
def test_equals_a_walk_over_all_passages(spark, held, question):
    index, docs, rows, _ = held
    asked = routing.read(spark, question, questions.NOW)
    got = routing.answered_from(index, docs, question, questions.NOW).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    want, outside = plain(held, question, questions.NOW, asked)
    assert [(r.doc_id, r.ordinal) for r in got] == want
    assert all(r.outside == outside for r in got)


def test_routes(spark):
    read = lambda k: routing.read(spark, routing.ASKED[k], questions.NOW)
    assert (read(0).focus, read(0).members, read(0).votes, read(0).period) == ("current", False, False, None)
    assert read(1).members and read(2).votes and read(3).period is not None
    assert "heon" in read(3).concepts and "2024" not in " ".join(read(3).concepts)
    assert read(4).concepts == ()


def test_scope_and_empty_archive(spark, held):
    index, docs, rows, _ = held
    got = routing.answered_from(index, docs, routing.ASKED[0], questions.NOW, session=110).collect()
    assert got and {rows[r.doc_id].session for r in got} == {110}
    none = docs.limit(0)
    for question in (routing.ASKED[1], routing.ASKED[4]):
        assert routing.answered_from(index, none, question, questions.NOW).collect() == []
