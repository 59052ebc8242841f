"""Quality rules as weak supervision.

Each rule votes for (1) or against (-1) a document or abstains (0).  Expectation-maximisation over the votes of all
documents estimates how each rule votes on good and on bad documents, and a document is kept if its posterior
probability of being good is at least ``threshold``, and the fixed base rules pass.  The votes are counted by pattern
where the documents are; the driver sees at most 3^rules counts, whatever the corpus.

Defined cases: a null or empty text has no words, so the base fails; null ids and repeated rows are judged each;
an empty table gives no rows and the starting model; other columns are ignored by the rules and carried by ``keep``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import text_stats

THRESHOLD = 0.5
BAD, ABSTAIN, GOOD = -1, 0, 1


def _ratio(n: str, of: str = "n_words") -> Column:
    return F.col(n) / F.greatest(F.col(of), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Name and vote of each rule, over the columns of ``text_stats``."""
    marked, bars, stutter, repeats = (_ratio(c) for c in ("n_marked_words", "n_bars", "n_stutter", "n_repeat_words"))
    shout, stop, size, lines = (F.col("n_caps_words") + F.col("n_bangs")) / F.greatest("n_words", F.lit(1)), _ratio("n_stop"), _ratio("word_chars"), _ratio("n_dup_lines", "n_lines")
    return {
        "symbols_in_words": _vote(marked > 0.05, marked < 0.01),
        "shouting": _vote(shout > 0.1, shout < 0.02),
        "table_bars": _vote(bars > 0.05, bars < 0.01),
        "stutter": _vote(stutter > 0.1, stutter < 0.03),
        "repeated_windows": _vote(repeats > 0.2, repeats < 0.05),
        "function_words": _vote((stop < 0.05) & (F.col("n_words") >= 20), stop > 0.12),
        "word_length": _vote((size < 2.5) | (size > 9), (size > 3.5) & (size < 6.5)),
        "repeated_lines": _vote(lines > 0.3, lines < 0.1),
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 40),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class LabelModel:
    """Two classes; rules vote independently given the class."""

    def __init__(self, n_rules: int):
        self.prior = np.array([0.2, 0.8])  # bad, good
        self.vote = np.empty((2, n_rules, 3))  # class, rule, vote + 1
        self.vote[0], self.vote[1] = [0.3, 0.2, 0.5], [0.02, 0.08, 0.9]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        log = np.log(self.prior)[None] + sum(np.log(self.vote[:, k, :])[:, patterns[:, k] + 1].T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        for _ in range(rounds if len(patterns) else 0):
            good = self.posterior(patterns)
            weight = np.stack([1 - good, good]) * counts
            before = self.prior
            self.prior = (weight.sum(1) + 2) / (weight.sum() + 4)
            for k in range(patterns.shape[1]):
                for v in range(3):
                    self.vote[:, k, v] = weight[:, patterns[:, k] + 1 == v].sum(1) + 1
            self.vote /= self.vote.sum(2, keepdims=True)
            if abs(self.prior - before).max() < 1e-9:
                break
        return self


def judge(docs: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text_stats columns, base_failed, posterior, kept, the long columns ``carry``), a row for every row.

    The statistics are written once; voting, counting and the verdict read them and not the text.
    """
    votes = rules()
    voted = C.written(text_stats.stats(docs, *carry).withColumn("votes", F.concat(*[(v + 1).cast("string") for v in votes.values()])))
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^rules
    patterns = np.array([[int(c) - 1 for c in r["votes"]] for r in rows], np.int64).reshape(len(rows), len(votes))
    model = LabelModel(len(votes)).fit(patterns, np.array([r["n"] for r in rows], np.float64))
    posterior = {r["votes"]: float(p) for r, p in zip(rows, model.posterior(patterns), strict=True)}
    table = docs.sparkSession.createDataFrame(list(posterior.items()) or [("", 0.0)], "votes string, posterior double")
    judged = voted.join(F.broadcast(table), "votes")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("votes")


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept.  A repeated doc_id goes if all its rows are rejected; null ids are judged apart."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id are told apart by their text
    keyed = docs.withColumn("_parchment_key", own)
    good = judge(keyed, threshold, ("_parchment_key",)).where("kept").select(F.col("doc_id").alias("_parchment_id"), F.col("_parchment_key").alias("_parchment_own")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_parchment_id")) & F.col("_parchment_key").eqNullSafe(F.col("_parchment_own"))
    return keyed.join(good, same, "left_semi").select(*docs.columns)
