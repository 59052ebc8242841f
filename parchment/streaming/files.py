"""A file's life: what becomes of each observation of it, as a stream with state and as a batch, by one step.

Texts never reach the state: what they are and how they read apart from their looks are digests, made by built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.operators.comparison import cosmetic_text


class Life(NamedTuple):
    """What is known of a file: the last observation, its time of change, and the digests of what is published, held and refused.

    ``look`` is the digest of a text without its looks, "" for a text without words.
    """

    seq: int
    modified: int | None
    published: str
    look: str
    held: str | None
    held_look: str | None
    refused: str | None


STATE = "seq long, modified long, published string, look string, held string, held_look string, refused string"
OUTCOMES = ("created", "unchanged", "same", "refused", "held", "updated", "accepted", "rejected", "ignored")


def step(life: Life | None, seq: int, action: str, governing: bool, modified: int | None, digest: str, look: str) -> tuple[Life | None, str]:
    """(what is known after an observation, what became of it).

    A first text is published.  Then, in this order: a file whose time of change is the one known is not read; a text that is
    published already takes back what was held; a text that a reviewer refused stays refused; a change of a governing text is
    held unless only its looks changed or there was no text; any other is published.  ``accept`` and ``reject`` settle what is
    held.  An observation that isn't newer than the last changes nothing, so a batch that comes twice does no harm.
    """
    if life is None:
        return (Life(seq, modified, digest, look, None, None, None), "created") if action == "seen" else (None, "ignored")
    if seq <= life.seq:
        return life, "ignored"
    life = life._replace(seq=seq)
    if action != "seen":
        if life.held is None:
            return life, "ignored"
        settled = life._replace(held=None, held_look=None)
        return (settled._replace(published=life.held, look=life.held_look), "accepted") if action == "accept" else (settled._replace(refused=life.held), "rejected")
    untouched = modified is not None and modified == life.modified
    if untouched and not (life.held is not None and not governing):
        return life, "unchanged"
    life = life._replace(modified=modified)
    if digest == life.published:
        return life._replace(held=None, held_look=None), "same"
    if digest == life.refused:
        return life, "refused"
    if governing and life.look and look != life.look:
        return life._replace(held=digest, held_look=look), "held"
    return life._replace(published=digest, look=look, held=None, held_look=None), "updated"


def _walk(life: Life | None, rows: Iterable) -> Iterator[tuple[Life | None, tuple]]:
    for r in rows:
        life, outcome = step(life, int(r.seq), r.action, bool(r.governing), None if pd.isna(r.modified) else int(r.modified), r.digest, r.look)
        told = (int(r.seq), outcome, *((life.published, life.held, life.refused) if life else (None, None, None)))
        yield life, told


def observed(rows: DataFrame) -> DataFrame:
    """(file_id, seq, action, governing, modified, digest, look) of observations (file_id, seq, action, kind, modified, content).

    ``modified`` is a time, null where the source has none; null texts are empty, a null action is "seen", and a null kind is
    no governing one.  Rows without an id or a number can't be placed in a file's life and are left out.
    """
    text = F.coalesce("content", F.lit(""))
    bare = cosmetic_text(text)
    return rows.where("file_id is not null and seq is not null").select(
        "file_id", F.col("seq").cast("long").alias("seq"), F.coalesce("action", F.lit("seen")).alias("action"), F.coalesce(F.col("kind").startswith("guiding."), F.lit(False)).alias("governing"),
        F.unix_millis(F.col("modified").cast("timestamp")).alias("modified"), F.sha2(text, 256).alias("digest"), F.when(bare == "", "").otherwise(F.sha2(bare, 256)).alias("look"))


def _told(rows: DataFrame) -> str:
    return f"file_id {dict(rows.dtypes)['file_id']}, seq long, outcome string, published string, held string, refused string"


def lives(rows: DataFrame) -> DataFrame:
    """(file_id, seq, outcome, published, held, refused): a row an observation, in batch.

    Files are dealt to tasks by id and walked in order of ``seq``; a task holds one file's state and one Arrow batch of digests,
    however long a file's life is.  Of rows that share id and number the first by digest counts, the others are ignored.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, life = None, None
        for frame in batches:
            out = []
            for name, part in frame.groupby("file_id", sort=False):
                if name != last:
                    last, life = name, None
                for life, told in _walk(life, part.itertuples(index=False)):  # noqa: B020
                    out.append((name, *told))
            yield pd.DataFrame(out, columns=["file_id", "seq", "outcome", "published", "held", "refused"])

    seen = observed(rows)
    return seen.repartition("file_id").sortWithinPartitions("file_id", "seq", "action", "digest").mapInPandas(walk, _told(seen))


def living(rows: DataFrame) -> DataFrame:
    """The same of a stream: state is a few digests a file.  A file's observations come in the order of their numbers, in any batches."""

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = Life(*state.get) if state.exists else None
        out = []
        for life, told in _walk(life, pd.concat(list(frames)).sort_values(["seq", "action", "digest"]).itertuples(index=False)):  # noqa: B007
            out.append((name[0], *told))
        if life is not None:
            state.update(tuple(life))
        yield pd.DataFrame(out, columns=["file_id", "seq", "outcome", "published", "held", "refused"])

    seen = observed(rows)
    return seen.groupBy("file_id").applyInPandasWithState(fold, _told(seen), STATE, "append", GroupStateTimeout.NoTimeout)


def standing(told: DataFrame) -> DataFrame:
    """(file_id, seq, published, held, refused): how files stand by what was told of them; rows told twice don't matter."""
    kept = told.where("outcome <> 'ignored'")
    return kept.groupBy("file_id").agg(F.max(F.struct("seq", "published", "held", "refused")).alias("x")).select("file_id", "x.seq", "x.published", "x.held", "x.refused")
