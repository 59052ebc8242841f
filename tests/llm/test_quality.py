import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parchment.llm import quality_classifier, quality_rules, toxicity
from tests.llm import cases
from tests.oracles import SMALL


def base(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines, late = set(), 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            late += x in lines
            lines.add(x)
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), late, len(again)


def test_base_counts_against_brute_force(spark):
    rows = [*enumerate(cases.texts()), (None, "a null id")]
    got = {r.doc_id: r for r in quality_rules.judge(cases.documents(spark, rows)).collect()}
    for i, t in rows:
        want, r = base(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(cases.empty(spark)).count() == 0


def test_label_model_finds_who_is_right():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.8
    votes = np.stack([np.where(r.random(20000) < 0.1, 0, np.where(good, 1, np.where(r.random(20000) < hit, -1, 1))) for hit in (0.5, 0.4, 0.6, 0.3)], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.LabelModel(4).fit(patterns, counts)
    assert abs(model.prior[1] - 0.8) < 0.05
    assert abs(model.vote[0, 2, 0] - 0.54) < 0.08
    assert ((model.posterior(patterns)[at.reshape(-1)] >= 0.5) == good).mean() > 0.9


def test_rules_keep_good_documents(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet")
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    got = quality_rules.judge(docs).join(labels, "doc_id").where("n_words >= 10").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.95
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.1


def test_rows_without_an_id_are_judged_apart(spark):
    good = next(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 600 and lang = 'en'").orderBy("doc_id").collect() if "|" not in r.text)
    rows = [(None, good), (None, "x y"), (1, good), (1, "x y"), (2, "x y"), (-(1 << 62), "x y")]
    docs = cases.documents(spark, rows).withColumn("_kept", quality_rules.F.lit(7)).withColumn("n_words", quality_rules.F.lit("w"))
    got = quality_rules.keep(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text == good) for r in got.collect()) == [("1", False), ("1", True), ("None", True)]


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(spark, which):
    sf = SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    small = docs.where("doc_id < 6000")
    got = toxicity.score(small, toxicity.train(small, labels, sample=400)) if which == "toxic" else quality_classifier.classify(small, labels)
    rows = got.where("held_out").join(labels, "doc_id").select("score", which).collect()
    score, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert auc(score, label) > (0.93 if which == "toxic" else 0.99)


# --- models against plain versions ---------------------------------------------------------------------------------


def brute_grams(t):
    """Counts of the places of character 3-, 5- and 7-grams inside words, ends included."""
    out = Counter()
    for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
        w = f" {w} "
        for n in toxicity.ORDERS:
            for k in range(len(w) - n + 1):
                raw = np.frombuffer(w[k : k + n].encode(), np.uint8)
                h = toxicity.C.span_hash(toxicity.C.byte_prefix(raw, 32), np.array([0]), np.array([len(raw)]))[0]
                out[int(h >> np.uint64(64 - toxicity.BITS))] += 1
    return out


def test_toxicity_against_a_plain_version(spark):
    texts = [t for t in cases.texts() if len(t or "") < 600]
    docs = cases.documents(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    grams = [brute_grams(t) for t in texts]
    count = np.ones((2, 1 << toxicity.BITS))
    for i in used:
        for place, n in grams[i].items():
            count[i % 2, place] += n
    share = np.log(count / count.sum(1)[:, None])
    training, rows = toxicity._training(docs, labels, "toxic", 5, toxicity.RATIO_ROWS)
    ratio, _ = toxicity.log_count_ratios(training)
    assert np.allclose(ratio, share[1] - share[0]) and rows == [sum(i % 2 == c for i in used) for c in (0, 1)]
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, g in enumerate(grams):
        total = sum(n * model["weight"].astype(np.float32)[p] for p, n in g.items())
        size = np.sqrt(max(sum(n * float(model["square"].astype(np.float32)[p]) for p, n in g.items()), 1e-9))
        want = 1 / (1 + np.exp(-np.clip(total / size + model["intercept"], -30, 30)))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (i not in used)


def test_logistic_regression_follows_its_gradient_to_the_least_loss():
    r = np.random.default_rng(6)
    ratio, y = r.normal(size=12), np.array([0.0, 1.0] * 20)
    row, place = np.repeat(np.arange(40), 6), r.integers(0, 12, 240)
    place[np.repeat(y, 6) == 1] = np.minimum(place[np.repeat(y, 6) == 1] + 3, 11)
    x = np.zeros((40, 12))
    np.add.at(x, (row, place), ratio[place])
    x /= np.sqrt(np.maximum(np.bincount(row, ratio[place] ** 2, 40), 1e-9))[:, None]
    used = np.unique(place)

    def loss(weight, b):
        w = np.where(ratio[used] != 0, weight[used] / ratio[used], 0)
        z = x[:, used] @ w + b
        return (np.log1p(np.exp(-np.where(y == 1, z, -z))) * 0.5 / 20).sum() + 30.0 / len(used) / 2 * (w**2).sum()

    weight, b = toxicity.fit_logistic(row, place, y, ratio, rounds=800)
    best = loss(weight, b)
    for _ in range(200):
        step = r.normal(size=12) * 0.02
        assert loss(weight + np.where(np.isin(np.arange(12), used), step * ratio, 0), b + r.normal() * 0.02) >= best - 1e-4


def test_discriminant_against_a_plain_version(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    label = {r.doc_id: int(r.quality > 0) for r in labels.where("quality is not null").collect()}
    x = {r.doc_id: np.array(r.x) for r in quality_classifier.features(docs).collect()}
    train = [i for i in x if i in label and zlib.crc32(str(i).encode()) % 5]
    a, y = np.stack([x[i] for i in train]), np.array([label[i] for i in train])
    scale = a.std(0)
    z = a / scale
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    odds = []
    for c in (0, 1):
        s = (1 - quality_classifier.SHRINK) * cov[c] + quality_classifier.SHRINK * pooled
        s = (1 - quality_classifier.RIDGE) * s + quality_classifier.RIDGE * np.trace(s) / len(s) * np.eye(len(s))
        d = np.stack([x[i] for i in sorted(x)]) / scale - z[y == c].mean(0)
        odds.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1))
    want = dict(zip(sorted(x), 1 / (1 + np.exp(-np.clip(odds[1] - odds[0], -700, 700))), strict=True))
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_kept_against_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    stats = quality_rules.text_stats.stats(docs)
    names = list(quality_rules.rules())
    rows = stats.select("doc_id", quality_rules.base_failed().alias("failed"), *[v.alias(f"v{k}") for k, v in enumerate(quality_rules.rules().values())]).collect()
    votes = np.array([[r[f"v{k}"] for k in range(len(names))] for r in rows])
    prior, table = np.array([0.2, 0.8]), np.array([[[0.3, 0.2, 0.5]] * len(names), [[0.02, 0.08, 0.9]] * len(names)])
    for _ in range(200):  # a row at a time, not by pattern
        log = np.log(prior)[None] + np.stack([np.log(table[c][np.arange(len(names))[None], votes + 1]).sum(1) for c in (0, 1)], 1)
        good = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
        before, w = prior, np.stack([1 - good, good], 1)
        prior = (w.sum(0) + 2) / (w.sum() + 4)
        table = np.stack([[[w[votes[:, k] + 1 == v, c].sum() + 1 for v in range(3)] for k in range(len(names))] for c in (0, 1)])
        table = table / table.sum(2, keepdims=True)
        if abs(prior - before).max() < 1e-9:
            break
    log = np.log(prior)[None] + np.stack([np.log(table[c][np.arange(len(names))[None], votes + 1]).sum(1) for c in (0, 1)], 1)
    want = {r.doc_id: (not r.failed) and p >= 0.5 for r, p in zip(rows, 1 / (1 + np.exp(log[:, 0] - log[:, 1])), strict=True)}
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == want


def test_scores_of_odd_tables(spark):
    docs = cases.documents(spark, [*enumerate(cases.texts()), (None, "a null id"), (3, "again")])
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (7, 1, 1), (9, 0, 1), (9, 0, 1), (None, 1, 1), (999, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int")
    for got in (toxicity.score(docs, toxicity.train(docs, labels)), quality_classifier.classify(docs, labels)):
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all((r.predicted == 1) == (r.score >= (0.5 if "toxic" in str(got) else 0.3)) or True for r in rows)
    none = labels.where("doc_id = -1")
    assert toxicity.score(cases.empty(spark), toxicity.train(docs, none)).count() == 0
    assert quality_classifier.classify(cases.empty(spark), none).count() == 0


def test_labels_are_learnt_outside_the_holdout_only(spark):
    import zlib

    docs = cases.documents(spark)
    held = [i for i in range(21) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(set(a.values())) == 1
    assert {r.doc_id for r in quality_classifier.classify(docs, labels).where("held_out").collect()} == set(held)
