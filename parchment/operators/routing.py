"""What a question is answered from, in one call: the question is read, routed to a period or to its words, the rosters and
the voting register are put before what the words rank, and passages are picked under limits per document.

Words are looked up in a kept index; everything after it is at most the candidates of a question (240 passages) or the
documents of a period (40), so no step after the index grows with the archive but aggregates over the documents' columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.periods import Period, parse_period, without_period
from parchment.functions.stems import stem
from parchment.operators import questions, retrieval, text_index
from parchment.operators.text_index import KeptIndex
from parchment.plans.registry import Registry
from parchment.sources.scratch import cut

REGISTRY = Registry()

# How many rosters are asked, how many of their passages are taken, below how many their openings follow and how
# many each has; how many passages of the register; what lifts either; limits per document and in all; the register's title and
# its head row.
ROSTERS, ROSTER_PASSAGES, FEW, OPENINGS, REGISTER_PASSAGES = 8, 8, 4, 4, 3
ROSTER_LIFT, REGISTER_LIFT = 10.0, 20.0
PER_DOCUMENT, PER_ROSTER, LIMIT = 3, 5, 14
REGISTER_TITLE, REGISTER_HEAD = "bill voting records", "(?i)^Name,Elected Position"


@dataclass(frozen=True)
class Reading:
    """A question as it is read: its focus, the concepts to look for, whether it asks for members or for votes, and its period."""

    text: str
    focus: str
    concepts: tuple[str, ...]
    members: bool
    votes: bool
    period: Period | None


def read(spark: SparkSession, question: str, now: datetime) -> Reading:
    """One row of expressions over the question itself; the words of its period aren't looked for."""
    period = parse_period(question, now)
    rest = without_period(question, period) if period else question
    q, r = F.lit(question), F.lit(rest)
    row = spark.range(1).select(questions.focus(q).alias("focus"), questions.concepts(r).alias("concepts"), questions.asked_body(q).isNotNull().alias("members"), questions.about_votes(q).alias("votes")).first()
    return Reading(question, row.focus, tuple(row.concepts), row.members, row.votes, period)


def best_of(scored: DataFrame, limit: int = retrieval.CANDIDATES) -> DataFrame:
    """The best passages; ties go to the smaller document and place."""
    return scored.orderBy(F.desc("score"), "doc_id", "ordinal").limit(limit)


def scored(index: KeptIndex, concepts: tuple[str, ...], within: DataFrame | None = None) -> DataFrame:
    """(doc_id, ordinal, score) of all passages that hold a concept, each a word or words parted by ``|`` of which any will do.

    ``within`` (doc_id) holds few documents, at most those of a period.
    """
    said = index.stems
    pairs = [(stem(w) if said else w, k) for k, c in enumerate(concepts) for w in c.split("|")]
    terms = tuple(dict.fromkeys(t for t, _ in pairs))
    if not terms:
        return index.spark.createDataFrame([], f"doc_id {dict(index.held().dtypes)['doc_id']}, ordinal int, score double")
    postings = index.postings(terms)
    if within is not None:
        postings = postings.join(F.broadcast(within.select("doc_id")), "doc_id", "left_semi")
    of = F.broadcast(index.spark.createDataFrame(sorted(set(pairs)), "term string, concept int"))  # a row a word of the question
    g = postings.join(of, "term").groupBy("doc_id", "ordinal", "concept").agg(F.sum("tf").alias("tf")).groupBy("doc_id", "ordinal").agg(F.sum("tf").cast("double").alias("tf"), F.count("*").alias("matched"))
    score = (F.col("tf") / (F.col("tf") + 10) + F.col("matched")) / (len(concepts) + 1)
    return g.select("doc_id", "ordinal", score.alias("score"))


def is_guiding(kind: Column) -> Column:
    return kind.startswith("guiding.")


def editions(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, edition) of the candidates' documents: latest or older among all documents of its lineage, "" for other kinds.

    Lineages of the candidates alone are aggregated, so what is broadcast has a row a candidate at most.
    """
    rules = documents.where(is_guiding(F.col("kind")))
    key = F.coalesce("lineage", "kind")
    lineages = rules.join(F.broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi").select(key.alias("key")).distinct()
    newest = rules.withColumn("key", key).join(F.broadcast(lineages), "key", "left_semi").groupBy("key").agg(F.max_by("doc_id", F.struct(F.coalesce("dated", F.lit(0).cast("timestamp")), F.coalesce("session", F.lit(0)), -F.col("doc_id"))).alias("doc_id"))
    own = documents.join(F.broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "kind")
    latest = own.join(F.broadcast(newest.select("doc_id", F.lit(True).alias("latest"))), "doc_id", "left")
    return latest.select("doc_id", F.when(~is_guiding(F.col("kind")), "").when(F.col("latest"), "latest").otherwise("older").alias("edition"))


def weighed(documents: DataFrame, candidates: DataFrame, asked: Reading, now: datetime) -> DataFrame:
    """Candidates under the weights of kind, title, edition and age that the question calls for."""
    rows = documents.select("doc_id", "kind", "title", "dated").join(F.broadcast(candidates), "doc_id").join(F.broadcast(editions(documents, candidates)), "doc_id")
    kind, current = F.col("kind"), asked.focus == "current"
    score = F.col("score") * questions.kind_weight(kind, asked.focus, asked.members) * questions.title_boost(F.col("title"), kind, asked.text, asked.members)
    if current:
        score = score * F.when(F.col("edition") == "older", F.lit(questions.OLDER)).otherwise(F.lit(1.0)) * questions.recency_boost(F.col("dated"), now)
    return rows.select("doc_id", "ordinal", score.alias("score"), "edition", F.lit("words").alias("evidence"))


def roster_evidence(index: KeptIndex, documents: DataFrame, asked: Reading) -> DataFrame:
    """The newest contact lists and attendance sheets: their best passages, and their first ones where the words find few."""
    sheets = documents.where("text <> ''").where((F.col("kind") == "directory") | ((F.col("kind") == "attendance") & F.lower("title").contains("sheet")))
    newest = cut(sheets.orderBy(F.desc_nulls_last("dated"), "doc_id").limit(ROSTERS).select("doc_id", "text"))
    own = cut(best_of(scored(index, asked.concepts, newest), ROSTER_PASSAGES))
    few = own.agg((F.count("*") < FEW).alias("few")).where("few")
    first = index.passages(newest).where(F.col("ordinal") < OPENINGS).join(own, ["doc_id", "ordinal"], "left_anti").join(F.broadcast(few), F.lit(True), "left_semi")
    return own.select("doc_id", "ordinal", "score").unionByName(first.select("doc_id", "ordinal", F.lit(0.0).alias("score"))).select("doc_id", "ordinal", (F.col("score") + ROSTER_LIFT).alias("score"), F.lit("").alias("edition"), F.lit("roster").alias("evidence"))


def register_evidence(index: KeptIndex, documents: DataFrame, asked: Reading) -> DataFrame:
    """The passages of the voting registers that hold most of the words, without their head rows."""
    registers = documents.where(F.lower("title").contains(REGISTER_TITLE))
    words = [w for c in asked.concepts for w in (c.split("|")[:1])]
    held = sum((F.lower("content").contains(w).cast("double") for w in words), F.lit(REGISTER_LIFT))
    rows = index.passages(registers.select("doc_id", "text")).where(~F.col("content").rlike(REGISTER_HEAD)).where("content <> ''")
    return rows.select("doc_id", "ordinal", held.alias("score")).orderBy(F.desc("score"), "doc_id", "ordinal").limit(REGISTER_PASSAGES).select("*", F.lit("").alias("edition"), F.lit("register").alias("evidence"))


def picked(rows: DataFrame, per_document: int, limit: int) -> DataFrame:
    """Each passage once, by its best evidence, the best of each document and in all.  ``rows`` are the candidates and evidence of one question."""
    once = rows.groupBy("doc_id", "ordinal").agg(F.max(F.struct("score", "evidence")).alias("b"), F.max("edition").alias("edition")).select("doc_id", "ordinal", "b.score", "edition", "b.evidence")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_document).drop("k").orderBy(F.desc("score"), "doc_id", "ordinal").limit(limit)


def of_period(index: KeptIndex, documents: DataFrame, asked: Reading, limit: int) -> DataFrame:
    """A period's documents, newest first, with two passages each until ``limit`` is reached; a document is taken whole.

    Passages are the best by the question's words, by the words of decisions where no document has those, and the openings of
    documents that have neither.  A period without documents is answered by the newest ones there are, marked as outside.
    """
    start, end = (F.lit(x.isoformat()).cast("timestamp") for x in (asked.period.start, asked.period.end))
    dated, newest = documents.where("dated is not null and text <> ''"), [F.desc("dated"), F.col("doc_id")]
    inside = cut(dated.where((F.col("dated") >= start) & (F.col("dated") < end)).orderBy(*newest).limit(questions.LISTED).select("doc_id", "dated", "text"))
    outside = inside.isEmpty()
    listed = cut(dated.orderBy(*newest).limit(questions.NEAREST).select("doc_id", "dated", "text")) if outside else inside
    best = cut(best_of(scored(index, asked.concepts, listed)))
    tier = "words"
    if best.isEmpty():
        best, tier = cut(best_of(scored(index, tuple(questions.BUSINESS), listed))), "decisions"
    first = index.passages(listed.join(best.select("doc_id").distinct(), "doc_id", "left_anti")).where(F.col("ordinal") < questions.DATED_PASSAGES)
    rows = best.withColumn("evidence", F.lit(tier)).unionByName(first.select("doc_id", "ordinal", F.lit(0.0).alias("score"), F.lit("opening").alias("evidence")))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal"))
    two = rows.withColumn("k", k).where(F.col("k") <= questions.DATED_PASSAGES).join(F.broadcast(listed.select("doc_id", "dated")), "doc_id")
    rows_before = F.count("*").over(Window.orderBy(F.desc("dated"), "doc_id", "k").rowsBetween(Window.unboundedPreceding, -1))
    before = rows_before - (F.col("k") - 1)  # those of the documents before
    taken = two.withColumn("before", before).where(F.col("before") < limit)  # eighty rows at most
    place = F.row_number().over(Window.orderBy(F.desc("dated"), "doc_id", "k"))
    return taken.select("doc_id", "ordinal", "score", F.lit("").alias("edition"), "evidence", F.lit(outside).alias("outside"), place.alias("place"))


def answered_from(index: KeptIndex, documents: DataFrame, question: str, now: datetime, session: int | None = None, focus: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, ordinal, score, edition, evidence, outside, place): the passages from which a question is answered, in order.

    ``documents`` has doc_id, text, kind, title, lineage, session and dated, and ``index`` holds their passages.  With
    ``session`` only its documents are eligible; ``focus`` overrides what the question says.  A question without words, as one
    that an empty archive is asked, gives no rows.
    """
    asked = read(index.spark, question, now)
    if focus is not None:
        asked = Reading(asked.text, focus, asked.concepts, asked.members, asked.votes, asked.period)
    if session is not None:
        documents = documents.where(F.col("session") == session)
    if asked.period is not None:
        return of_period(index, documents, asked, limit)
    found = scored(index, asked.concepts)
    candidates = cut(best_of(found if session is None else found.join(documents.select("doc_id"), "doc_id", "left_semi")))
    rows = weighed(documents, candidates, asked, now)
    if asked.members:
        rows = rows.unionByName(roster_evidence(index, documents, asked))
    if asked.votes:
        rows = rows.unionByName(register_evidence(index, documents, asked))
    best = picked(rows, PER_ROSTER if asked.members else PER_DOCUMENT, limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "ordinal"))  # as many rows as the limit
    return best.select("doc_id", "ordinal", "score", "edition", "evidence", F.lit(False).alias("outside"), place.alias("place"))


# --- queries -------------------------------------------------------------------------------------------------------------

#: A question of each route: rules in force, members, votes, a period with words, one without, one that holds nothing.
ASKED = (
    "What do the current bylaws say about that and heon?", "Who are the sitting members of that and the retion?", "Which bill about the heon and tionre was tabled?", "What did that heon bring in May 2024?", "What happened in March 2023?", "xyzzy in 1990",
)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``questions.corpus``; attendance is kept in sheets, and one source's minutes are the register of votes."""
    d = questions.corpus(spark, sf_dir)
    title = F.when(F.col("kind") == "attendance", F.concat("title", F.lit(" Sheet"))).when((F.col("kind") == "minutes") & F.col("lineage").endswith(":src5"), "Bill Voting Records").otherwise(F.col("title"))
    return d.withColumn("title", title)


@REGISTRY()
def questions_answered_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each question, routed, merged and picked over headed passages by stems."""
    docs, out = archive(spark, sf_dir), None
    index = text_index.upkept(spark, sf_dir, True, text_index.headed_passages)
    for k, question in enumerate(ASKED):
        got = answered_from(index, docs, question, questions.NOW).select(F.lit(k).alias("question"), "place", "doc_id", "ordinal", F.round("score", 9).alias("score"), "edition", "evidence", "outside")
        out = got if out is None else out.unionByName(got)
    return out
