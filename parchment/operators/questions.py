"""Questions: how they are read, the index they meet, weighted retrieval, retrieval by period, matches, answers and rosters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.periods import Period, parse_period, without_period
from parchment.functions.stems import stem
from parchment.operators import retrieval
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: Cues of a question about how things used to be.
HISTORICAL = (
    r"\bwhen (?:was|were|did|is the last)\b", r"\blast time\b", r"\bused to\b", r"\bprevious\b", r"\bprior\b", r"\bhistor(?:y|ical)\b", r"\boriginally\b", r"\bfirst time\b", r"\bover time\b",
    r"\bover the years\b", r"\bconstitutional crisis\b", r"\bcrisis\b", r"\bcompar(?:e|ing|ed)\b", r"\bhow ha(?:s|ve)\b", r"\b(?:have|has|had)(?:\s+\w+){0,5}\s+changed\b", r"\bwhat changed\b", r"\bbetween the\b",
    r"\b(?:earliest|oldest)\b.{0,48}\b(?:bylaws?|constitution|edition|version|archive|document|minutes|record|stuff)\b", r"\b(?:bylaws?|constitution|edition|version|archive|document|minutes|record|stuff)\b.{0,48}\b(?:earliest|oldest)\b",
)
#: Words of the rules, and of the present.
RULES, PRESENT = r"\b(?:rules?|law|constitution|bylaws?|procedure|requirements?)\b", r"\b(?:current|currently|now|latest|most recent|in force)\b"
#: Bodies and how a question names them, the first that fits.
BODIES = (
    ("judiciary", r"\bjudiciar|\bjustices?\b"), ("caucus", r"\bcaucus"), ("programming", r"\bprogramming\b"), ("cse", r"\bcse\b|committee on student elections|elections committee"), ("staff", r"\bstaff\b|\badvisors?\b"),
    ("executive", r"\bexecutive\b|\bcabinet\b|e-?board|\bexec\b"), ("senate", r"\bsenate|\bsenators?\b"),
)
ROSTER = (r"\bwho(?:'s| is)\s+in\b", r"\b(?:current|sitting|serving)\s+(?:members?|justices?|officers?|senators?|cabinet|roster|directory)\b")
WHOLE_BODY = r"student government|\b(?:current|sitting|serving)\s+(?:members?|officers?|roster|directory)\b"
VOTES = (r"\b(?:pass(?:ed|age)?|adopt(?:ed|ion)|tabled|rejected)\b", r"\b(?:bill|legislation|resolution|amendment)\b", r"\b(?:vote|votes|voting|status)\b")
STANDING, HAPPENED = r"\b(?:constitution|bylaws?)\b", r"\b(?:happened|happen|minutes|meetings?|bills?|news|passed|voted|introduced)\b"

QUESTIONS = (
    "When was the first caucus position introduced?", "How have the bylaws changed over time?", "What are the current rules of procedure?", "Who is currently in the Judiciary branch?", "Who's in the cabinet?",
    "Which bills were tabled?", "What is the status of the housing resolution", "the most recent constitution", "Was the constitution news passed?", "Who are the sitting members", "who can I talk to now", "What did the motions say, and who moved?",
    "list the serving senators and the motion", "oldest version of the bylaws", "Who is serving in the executive board now?",
)


def focus(text: Column) -> Column:
    """historical, current or archive."""
    said = lambda p: text.rlike(f"(?i){p}")
    old = F.lit(False)
    for p in HISTORICAL:
        old = old | said(p)
    return F.when(old, "historical").when(said(RULES) & said(PRESENT), "current").otherwise("archive")


def asked_body(text: Column) -> Column:
    """The body whose members a question asks for, "all", or null where it asks for none."""
    low = F.lower(text)
    roster = (low.rlike(r"\bwho\b") & low.rlike(r"\b(?:currently|sitting|serving|sits)\b")) | low.rlike(ROSTER[0]) | low.rlike(ROSTER[1])
    body = F.when(~roster, F.lit(None).cast("string"))
    for name, p in BODIES:
        body = body.when(low.rlike(p), name)
    return body.when(low.rlike(WHOLE_BODY), "all")


def about_votes(text: Column) -> Column:
    said = lambda p: text.rlike(f"(?i){p}")
    return said(VOTES[0]) | (said(VOTES[1]) & said(VOTES[2]))


def standing(text: Column) -> Column:
    return text.rlike(f"(?i){STANDING}") & ~text.rlike(f"(?i){HAPPENED}")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): what users said, and some questions with negative ids."""
    own = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTIONS)], "id long, text string")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").unionByName(own)


_ASKED = "asked as (select (conv_id * 1000 + turn)::bigint as id, text from conversations where role = 'user' union all values " + ", ".join("({}, '{}')".format(-1 - i, q.replace("'", "''")) for i, q in enumerate(QUESTIONS)) + ")"
_q = lambda p: p.replace("'", "''")
_said = lambda p, c="text": f"regexp_matches({c}, '(?i){_q(p)}')"
_FOCUS = f"case when {' or '.join(map(_said, HISTORICAL))} then 'historical' when {_said(RULES)} and {_said(PRESENT)} then 'current' else 'archive' end"
_ROSTER = f"(({_said(chr(92) + 'bwho' + chr(92) + 'b')} and {_said(r'\b(?:currently|sitting|serving|sits)\b')}) or {_said(ROSTER[0])} or {_said(ROSTER[1])})"
_BODY = f"case when not {_ROSTER} then null " + " ".join(f"when {_said(p)} then '{n}'" for n, p in BODIES) + f" when {_said(WHOLE_BODY)} then 'all' end"
_VOTES = f"({_said(VOTES[0])} or ({_said(VOTES[1])} and {_said(VOTES[2])}))"


@REGISTRY(f"with {_ASKED} select id, {_FOCUS} as focus, {_BODY} as body, {_VOTES} as about_votes, {_said(STANDING)} and not {_said(HAPPENED)} as standing from asked where text is not null")
def question_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question is read: its focus, the body it asks for, whether it is about votes or a standing rule."""
    t = F.col("text")
    return asked(spark, sf_dir).where("text is not null").select("id", focus(t).alias("focus"), asked_body(t).alias("body"), about_votes(t).alias("about_votes"), standing(t).alias("standing"))


#: Words that describe a question and not its subject.
NOISE = (
    "how many much what whats when where who whom whose why which can could should would may might must shall will does did was were are is be been being am do done have has had there here "
    "the a an of to in on at for from by with about into over under and or but if than then that this these those it its as any all some get tell me you i we they please know like make makes made making "
    "happen happens happened happening going anything everything something nothing else news recap update student students government association document documents"
).split()
#: Other words for a concept.
ALTERNATIVES = {"motion": "motion|moved", "motions": "motion|moved"}
EXTRA = (("judiciar", ("justice", "justices", "judiciary", "chief")), (r"\bsenate\b|\bsenators?\b", ("senator", "senators")), ("executive|cabinet|e-?board", ("president", "cabinet", "executive")))


def concepts(text: Column) -> Column:
    """The concepts of a question: at most 24 distinct terms and what a roster question adds, each with its alternatives."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*NOISE))
    terms = F.slice(F.array_distinct(words), 1, 24)
    for p, more in EXTRA:
        terms = F.when(asked_body(text).isNotNull() & F.lower(text).rlike(p), F.concat(terms, F.array(*map(F.lit, more)))).otherwise(terms)
    swap = F.create_map(*[F.lit(x) for pair in ALTERNATIVES.items() for x in pair])
    return F.array_distinct(F.transform(terms, lambda w: F.coalesce(F.try_element_at(swap, w), w)))


_NOISE = ", ".join(f"'{w}'" for w in NOISE)
_TERMS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2 and w not in ({_NOISE}))"
_DISTINCT = "list_transform(list_filter(list_transform({0}, lambda x, i: struct_pack(x := x, i := i)), lambda e: list_position({0}, e.x) = e.i), lambda e: e.x)"
_MORE = " || ".join(f"case when b is not null and {_said(p)} then [{', '.join(repr(w) for w in more)}] else []::varchar[] end" for p, more in EXTRA)


@REGISTRY(f"""with {_ASKED}, t as (select id, text, {_BODY} as b, {_TERMS} as w from asked where text is not null), d as (select id, text, b, {_DISTINCT.format('w')}[1 : 24] as w from t),
m as (select id, list_transform(w || {_MORE}, lambda x: case when x in ('motion', 'motions') then 'motion|moved' else x end) as w from d)
select id, array_to_string({_DISTINCT.format('w')}, ' ') as concepts from m""")
def question_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts of each question in order of first use; alternatives count as one."""
    return asked(spark, sf_dir).where("text is not null").select("id", F.array_join(concepts(F.col("text")), " ").alias("concepts"))


# --- the index -----------------------------------------------------------------------------------------------------


def inverted_index(passages: DataFrame, keys: tuple[str, ...] = ("doc_id", "ordinal"), content: str = "content") -> DataFrame:
    """(term, keys, tf): terms of each passage with how often it has them; counted before the shuffle, and a filter on terms
    goes below the count."""
    return passages.select(*keys, F.explode(retrieval.tokens(F.col(content))).alias("term")).groupBy("term", *keys).agg(F.count("*").alias("tf"))


@REGISTRY(f"""with {retrieval._LINES}, t as (select doc_id, ordinal, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from lines where doc_id % 1 = 0)
select term, count(distinct doc_id)::bigint as documents, count(distinct (doc_id, ordinal))::bigint as passages, count(*)::bigint as uses from t group by 1""".replace(" where doc_id % 1 = 0", ""))
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's dictionary: in how many documents and passages each term stands, and how often."""
    words = retrieval.passages(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.explode(retrieval.tokens(F.col("content"))).alias("term"))
    postings = words.groupBy("term", "doc_id", "ordinal").agg(F.count("*").alias("tf"))
    by_document = postings.groupBy("term", "doc_id").agg(F.count("*").alias("p"), F.sum("tf").alias("tf"))
    return by_document.groupBy("term").agg(F.count("*").alias("documents"), F.sum("p").alias("passages"), F.sum("tf").alias("uses"))


@REGISTRY(f"with {retrieval._SCORED} select doc_id, ordinal, score from scored order by score desc, doc_id, ordinal limit 100")
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked passages from the postings of the question's terms: the texts aren't read again, one group a passage."""
    postings = inverted_index(retrieval.passages(table(spark, sf_dir, "documents"))).where(F.col("term").isin(*retrieval.TERMS))
    g = postings.groupBy("doc_id", "ordinal").agg(F.sum("tf").cast("double").alias("tf"), F.count("*").alias("matched"))
    return g.select("doc_id", "ordinal", ((F.col("tf") / (F.col("tf") + 10) + F.col("matched")) / (len(retrieval.TERMS) + 1)).alias("score")).orderBy(F.desc("score"), "doc_id", "ordinal").limit(100)


def stemmed_forms(words: DataFrame, stems: tuple[str, ...], word: str = "term") -> DataFrame:
    """(term, stem) of the words whose stem is among ``stems``; each distinct word is stemmed once, in Arrow batches."""

    def run(batches):
        for frame in batches:
            got = frame[word].map(stem)
            yield frame.assign(stem=got)[got.isin(stems)]

    return words.select(word).distinct().mapInPandas(run, f"{word} string, stem string")


def ranked_by_stem(postings: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(doc_id, ordinal, score) of passages by the stems of ``terms``: a stem counts once however many of its forms stand there."""
    stems = tuple(dict.fromkeys(map(stem, terms)))
    g = postings.join(stemmed_forms(postings, stems), "term").groupBy("doc_id", "ordinal", "stem").agg(F.sum("tf").alias("tf")).groupBy("doc_id", "ordinal").agg(F.sum("tf").cast("double").alias("tf"), F.count("*").alias("matched"))
    return g.select("doc_id", "ordinal", ((F.col("tf") / (F.col("tf") + 10) + F.col("matched")) / (len(stems) + 1)).alias("score"))


STEMMED = ("nations", "relating", "themed", "inventions", "handing", "thing")


@REGISTRY()
def search_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred passages for words in any of their English forms."""
    postings = inverted_index(retrieval.passages(table(spark, sf_dir, "documents")))
    return ranked_by_stem(postings, STEMMED).orderBy(F.desc("score"), "doc_id", "ordinal").limit(100)


# --- weighted retrieval --------------------------------------------------------------------------------------------

#: Weights of kinds for a question about the rules in force, for one about members, and the penalty of an older edition.
CURRENT_WEIGHTS = {"guiding.constitution": 1.6, "guiding.bylaws": 1.45}
GUIDING, SHEET, OLDER = 1.3, 0.6, 0.35
MEMBER_WEIGHTS = {"directory": 2.6, "attendance": 1.8}
#: How much newer documents count, by years below.
RECENCY = ((0.5, 1.2), (1.5, 1.12), (3, 1.05))
YEAR = 365.25 * 86400


def kind_weight(kind: Column, focus_: str, members: bool = False) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    if members:
        for k, w in MEMBER_WEIGHTS.items():
            out = out.when(kind == k, F.lit(w))
        out = out.when(kind.startswith("guiding."), F.lit(0.55))
    if focus_ == "current":
        for k, w in CURRENT_WEIGHTS.items():
            out = out.when(kind == k, F.lit(w))
        out = out.when(kind.startswith("guiding."), F.lit(GUIDING))
    return out.when(kind.isin("attendance", "directory"), F.lit(SHEET)).otherwise(F.lit(1.0))


def title_boost(title: Column, kind: Column, question: str, members: bool = False) -> Column:
    import re

    asked_, named, out = question.lower(), F.lower(title), F.when(F.lit(False), F.lit(1.0))
    if members:
        out = out.when(named.contains("guideline"), F.lit(0.25)).when(named.rlike("sheet|roster|email list|contact list|directory"), F.lit(1.6))
    if "constitution" in asked_:
        elections = r"\bcse\b|elections"
        if not re.search(elections, asked_):
            out = out.when((kind == "guiding.constitution") & named.rlike(elections), F.lit(0.35))
        out = out.when(kind == "guiding.constitution", F.lit(1.35))
    if re.search("bylaws?", asked_):
        out = out.when(kind == "guiding.bylaws", F.lit(1.35))
    if "crisis" in asked_:
        out = out.when(kind == "newsletter.article", F.lit(1.3))
    return out.otherwise(F.lit(1.0))


def recency_boost(date: Column, now: datetime) -> Column:
    years = (F.lit(now.timestamp()) - F.unix_micros(date.cast("timestamp")) / 1e6) / YEAR
    out = F.when(date.isNull(), F.lit(1.0))
    for below, w in RECENCY:
        out = out.when(years < below, F.lit(w))
    return out.otherwise(F.lit(1.0))


def newest_editions(documents: DataFrame) -> DataFrame:
    """(document, lineage): the newest edition of each lineage of rules, by date, session and id."""
    g = documents.where(F.col("kind").startswith("guiding.")).groupBy("lineage")
    return g.agg(F.max_by("doc_id", F.struct(F.coalesce("dated", F.lit(0).cast("timestamp")), F.coalesce("session", F.lit(0)), -F.col("doc_id"))).alias("newest")).select("newest")


def retrieve(passages: DataFrame, documents: DataFrame, question: str, terms: tuple[str, ...], now: datetime, focus_: str, per_document: int = 3, limit: int = 14) -> DataFrame:
    """The passages a question is answered from: (doc_id, ordinal, score, edition), ranked by words, kind, title, edition and age.

    ``documents`` has doc_id, kind, title, lineage, session, dated.  The candidates are the best 240, so all that follows
    is on a bounded table.
    """
    best = retrieval.scored(passages, terms).select("doc_id", "ordinal", "score").orderBy(F.desc("score"), "doc_id", "ordinal").limit(retrieval.CANDIDATES)
    rows = documents.select("doc_id", "kind", "title", "dated").join(F.broadcast(best), "doc_id")
    rows = rows.join(F.broadcast(newest_editions(documents)), F.col("doc_id") == F.col("newest"), "left") if focus_ == "current" else rows.withColumn("newest", F.lit(None).cast("long"))
    older = F.col("kind").startswith("guiding.") & F.col("newest").isNull()
    score = F.col("score") * kind_weight(F.col("kind"), focus_)
    if focus_ == "current":
        score = score * F.when(older, F.lit(OLDER)).otherwise(F.lit(1.0))
    score = score * title_boost(F.col("title"), F.col("kind"), question)
    if focus_ == "current":
        score = score * recency_boost(F.col("dated"), now)
    rows = rows.select("doc_id", "ordinal", F.round(score, 9).alias("score"), F.when(~F.col("kind").startswith("guiding."), "").when(older, "older").otherwise("latest").alias("edition"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_document).drop("k").orderBy(F.desc("score"), "doc_id", "ordinal").limit(limit)


KINDS = {"en": "guiding.bylaws", "fr": "guiding.constitution", "de": "attendance", "es": "minutes"}
NOW = datetime(2026, 3, 18, tzinfo=timezone.utc)
QUESTION = "What do the current bylaws say about that and heon?"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a kind, a title, a session, a lineage and, most of them, a date."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("lang")), F.lit("directory"))
    dated = F.when(F.col("doc_id") % 5 != 0, F.lit("2018-01-01").cast("timestamp") + F.make_dt_interval(F.expr("cast(doc_id * 7 % 3000 as int)")))
    return d.select("doc_id", "text", kind.alias("kind"), F.split("text", " ", 2)[0].alias("title"), (108 + F.col("doc_id") % 7).cast("int").alias("session"), F.concat_ws(":", kind, "source").alias("lineage"), dated.alias("dated"))


_KIND = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " else 'directory' end"
_CORPUS = f"""corpus as (select doc_id, text, {_KIND} as kind, split_part(text, ' ', 1) as title, (108 + doc_id % 7)::int as session, {_KIND} || coalesce(':' || source, '') as lineage,
 case when doc_id % 5 <> 0 then timestamp '2018-01-01' + to_days((doc_id * 7 % 3000)::int) end as dated from documents where text is not null)"""
_YEARS = f"((epoch(timestamp '2026-03-18') - epoch(dated)) / {YEAR})"


@REGISTRY(f"""with {retrieval._SCORED}, {_CORPUS}, cand as (select doc_id, ordinal, score from scored order by score desc, doc_id, ordinal limit {retrieval.CANDIDATES}),
newest as (select max_by(doc_id, (coalesce(dated, timestamp '1970-01-01'), coalesce(session, 0), -doc_id)) as newest from corpus where starts_with(kind, 'guiding.') group by lineage),
r as (select c.doc_id, ordinal, starts_with(kind, 'guiding.') and newest is null as older, starts_with(kind, 'guiding.') as guiding,
 score * (case kind when 'guiding.constitution' then 1.6::double when 'guiding.bylaws' then 1.45::double when 'attendance' then 0.6::double when 'directory' then 0.6::double else 1 end)
  * (case when starts_with(kind, 'guiding.') and newest is null then 0.35::double else 1 end) * (case when kind = 'guiding.bylaws' then 1.35::double else 1 end)
  * (case when dated is null then 1 when {_YEARS} < 0.5 then 1.2::double when {_YEARS} < 1.5 then 1.12::double when {_YEARS} < 3 then 1.05::double else 1 end) as score
 from cand c join corpus d on c.doc_id = d.doc_id left join newest on d.doc_id = newest),
k as (select doc_id, ordinal, round(score, 9) as score, case when not guiding then '' when older then 'older' else 'latest' end as edition, row_number() over (partition by doc_id order by round(score, 9) desc, ordinal) as k from r)
select doc_id, ordinal, score, edition from k where k <= 3 order by score desc, doc_id, ordinal limit 14""")
def retrieve_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about the rules in force: latest editions, newer documents and the asked kind come first."""
    docs = corpus(spark, sf_dir)
    return retrieve(retrieval.passages(docs), docs, QUESTION, retrieval.TERMS, NOW, "current")


def with_evidence(ranked: DataFrame, evidence: DataFrame, offset: float, per_document: int = 5, limit: int = 14) -> DataFrame:
    """Ranked passages behind the best of an evidence list, whose scores are lifted above them; each passage once."""
    lifted = evidence.withColumn("score", F.col("score") + offset)
    once = ranked.unionByName(lifted).groupBy("doc_id", "ordinal").agg(F.max("score").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_document).drop("k").orderBy(F.desc("score"), "doc_id", "ordinal").limit(limit)


@REGISTRY(f"""with {retrieval._SCORED}, {_CORPUS}, cand as (select doc_id, ordinal, score from scored order by score desc, doc_id, ordinal limit {retrieval.CANDIDATES}),
rosters as (select doc_id from corpus where text <> '' and kind = 'directory' or kind = 'attendance' and contains(lower(title), 'e') order by dated desc nulls last, doc_id limit 8),
own as (select doc_id, ordinal, 10 + score as score from (select s.* from scored s join rosters using (doc_id) order by score desc, doc_id, ordinal limit 8)),
openings as (select doc_id, ordinal, 10::double as score from lines join rosters using (doc_id) where ordinal < 4 and (select count(*) from own) < 4),
u as (select doc_id, ordinal, max(score) as score from (select doc_id, ordinal, score from cand union all select doc_id, ordinal, score from own union all select doc_id, ordinal, score from openings) group by all),
k as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from u) select doc_id, ordinal, score from k where k <= 5 order by score desc, doc_id, ordinal limit 14""")
def retrieve_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about members: passages of the rosters come first, and their openings where the words find too few."""
    docs = corpus(spark, sf_dir)
    lines = retrieval.passages(docs)
    order = [F.desc("score"), F.col("doc_id"), F.col("ordinal")]
    ranked = retrieval.scored(lines, retrieval.TERMS).select("doc_id", "ordinal", "score")
    rosters = F.broadcast(docs.where("text <> '' and kind = 'directory' or kind = 'attendance' and contains(lower(title), 'e')").orderBy(F.desc_nulls_last("dated"), "doc_id").limit(8).select("doc_id"))
    own = ranked.join(rosters, "doc_id", "left_semi").orderBy(*order).limit(8)
    few = own.agg((F.count("*") < 4).alias("few")).where("few")
    openings = lines.where("ordinal < 4").join(rosters, "doc_id", "left_semi").join(F.broadcast(few), F.lit(True), "left_semi").select("doc_id", "ordinal", F.lit(0.0).alias("score"))
    return with_evidence(ranked.orderBy(*order).limit(retrieval.CANDIDATES), own.unionByName(openings), 10.0)


@REGISTRY(f"""with {retrieval._LINES}, {_CORPUS}, v as (select doc_id, ordinal, 20 + {' + '.join(f"contains(lower(content), '{t}')::int" for t in retrieval.TERMS)} as score from lines join corpus using (doc_id) where kind = 'minutes' and title = (select min(title) from corpus where kind = 'minutes') and content <> '')
select doc_id, ordinal, score::bigint as score from v order by score desc, doc_id, ordinal limit 3""")
def voting_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages of the voting register that hold most terms."""
    docs = corpus(spark, sf_dir).where("kind = 'minutes'")
    register = docs.join(F.broadcast(docs.agg(F.min("title").alias("title"))), "title", "left_semi")
    held = sum((F.lower("content").contains(t).cast("int") for t in retrieval.TERMS), F.lit(20))
    return retrieval.passages(register).where("content <> ''").select("doc_id", "ordinal", held.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id", "ordinal").limit(3)


# --- periods -------------------------------------------------------------------------------------------------------

#: Words in which decisions are recorded.
BUSINESS = "motion moved second vote voted passed failed approved rejected resolution bill amendment elected appointed confirmed funding allocated budget adopted introduced report discussed decided tabled".split()
LISTED, NEAREST, DATED_PASSAGES = 40, 6, 2


def retrieve_period(documents: DataFrame, period: Period, terms: tuple[str, ...], limit: int = 14) -> DataFrame:
    """(doc_id, ordinal, place, outside) for a question about a period: documents dated in it, newest first, with two passages each.

    Passages are those that the words rank best, else those of decisions, else the openings.  Where the period is empty the
    nearest documents at hand, the newest, stand in, marked as outside.
    """
    start, end = (F.lit(x.isoformat()).cast("timestamp") for x in (period.start, period.end))
    dated = documents.where("dated is not null")
    newest = [F.desc("dated"), F.col("doc_id")]
    inside = dated.where((F.col("dated") >= start) & (F.col("dated") < end))
    some = inside.limit(1).select(F.lit(1).alias("some"))
    stand_in = dated.orderBy(*newest).limit(NEAREST).join(F.broadcast(some), F.lit(True), "left_anti").withColumn("outside", F.lit(True))
    listed = inside.orderBy(*newest).limit(LISTED).withColumn("outside", F.lit(False)).unionByName(stand_in)
    listed = listed.withColumn("place", F.row_number().over(Window.orderBy(*newest)))  # forty rows at most
    lines = retrieval.passages(listed)
    by_word = retrieval.scored(lines, terms).select("doc_id", "ordinal", "score", F.lit(2).alias("tier"))
    tiers = by_word.unionByName(retrieval.scored(lines, tuple(BUSINESS)).select("doc_id", "ordinal", "score", F.lit(1).alias("tier")))
    best = tiers.agg(F.max("tier").alias("tier"))  # words if any document has them, else decisions
    ranked = tiers.join(F.broadcast(best), "tier", "left_semi").drop("tier")
    openings = lines.where(F.col("ordinal") < DATED_PASSAGES).join(ranked.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "ordinal", F.lit(0.0).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    two = ranked.unionByName(openings).withColumn("k", F.row_number().over(w)).where(F.col("k") <= DATED_PASSAGES)
    return listed.select("doc_id", "place", "outside").join(two, "doc_id").orderBy("place", "k").limit(limit).select("doc_id", "ordinal", "place", "outside")


def _period_sql(start: str, end: str, terms: tuple[str, ...]) -> str:
    tier = lambda ts, k: (f"select doc_id, ordinal, {k} as tier, (tf / (tf + 10) + matched) / {len(ts) + 1} as score from (select doc_id, ordinal, len(list_intersect(list_distinct(t), [{', '.join(map(repr, ts))}])) as matched, "  # noqa: E731
                          f"len(list_filter(t, lambda x: x in ({', '.join(map(repr, ts))})))::double as tf from tok) where matched > 0")
    return f"""with {_CORPUS}, dated as (select * from corpus where dated is not null), inside as (select * from dated where dated >= timestamp '{start}' and dated < timestamp '{end}'),
listed as (select *, row_number() over (order by dated desc, doc_id)::int as place from (select * from (select *, false as outside from inside order by dated desc, doc_id limit {LISTED})
 union all select * from (select *, true as outside from dated where (select count(*) from inside) = 0 order by dated desc, doc_id limit {NEAREST}))),
lines as (select doc_id, unnest(range(len(s)))::int as ordinal, unnest(s) as content from (select doc_id, string_split(text, chr(10)) as s from listed)),
tok as (select doc_id, ordinal, regexp_extract_all(lower(content), '[a-z0-9]+') as t from lines), tiers as ({tier(terms, 2)} union all {tier(tuple(BUSINESS), 1)}),
ranked as (select doc_id, ordinal, score from tiers where tier = (select max(tier) from tiers)), openings as (select doc_id, ordinal, 0::double as score from lines where ordinal < {DATED_PASSAGES} and doc_id not in (select doc_id from ranked)),
k as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from (select * from ranked union all select * from openings))
select doc_id, ordinal, place, outside from listed join k using (doc_id) where k <= {DATED_PASSAGES} order by place, k limit 14"""


@REGISTRY(_period_sql("2024-05-01 04:00:00", "2024-06-01 04:00:00", ("that", "heon")))
def retrieve_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question about a month is answered from."""
    question = "What did that heon bring in May 2024?"
    return retrieve_period(corpus(spark, sf_dir), parse_period(question, NOW), ("that", "heon"))


@REGISTRY(_period_sql("1990-01-01 05:00:00", "1991-01-01 05:00:00", ("xyzzy",)))
def retrieve_outside_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year that the archive holds nothing of, asked with a word that it doesn't hold either."""
    question = "xyzzy in 1990"
    period = parse_period(question, NOW)
    return retrieve_period(corpus(spark, sf_dir), period, (without_period(question, period),))


# --- matches and answers -------------------------------------------------------------------------------------------


@REGISTRY(f"""with {retrieval._SCORED}, top as (select doc_id, ordinal, score from scored order by score desc, doc_id, ordinal limit 60), b as (select doc_id, min_by(ordinal, (-score, ordinal)) as ordinal from top group by 1)
select b.doc_id, b.ordinal, left(regexp_replace(content, '[ \\t\\n\\r\\f]+', ' ', 'g'), 300) as excerpt, case when quality = 1 and toxic = 0 then 'rated' else '' end as summary from b join lines l on l.doc_id = b.doc_id and l.ordinal = b.ordinal left join labels on labels.doc_id = b.doc_id""")
def matched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind the best passages: the first passage of each, cut to 300 characters, and its summary where one is shown."""
    top = retrieval.scored(retrieval.passages(table(spark, sf_dir, "documents")), retrieval.TERMS).orderBy(F.desc("score"), "doc_id", "ordinal").limit(60)
    first = top.groupBy("doc_id").agg(F.min_by(F.struct("ordinal", "content"), F.struct(-F.col("score"), "ordinal")).alias("p"))
    shown = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "rated").otherwise("").alias("summary"))
    return first.join(shown, "doc_id", "left").select("doc_id", "p.ordinal", F.substring(F.regexp_replace("p.content", r"[ \t\n\r\f]+", " "), 1, 300).alias("excerpt"), F.coalesce("summary", F.lit("")).alias("summary"))


def normalised_question(text: Column) -> Column:
    """White space, case and the last marks are no part of a question."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")), r"[ \t\n\r\f]+", " "), "[?!.]+$", "")


_NORMAL = r"regexp_replace(regexp_replace(lower(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), '[ \t\n\r\f]+', ' ', 'g'), '[?!.]+$', '')"
VERSION = "answers-1"


@REGISTRY(f"with {_ASKED} select id, sha256('{VERSION}' || chr(10) || 'all' || chr(10) || ({_FOCUS}) || chr(10) || {_NORMAL} || chr(10)) as key from asked where text is not null")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which an answer is kept: the rules' version, scope, focus, words and period (here none)."""
    t = F.col("text")
    return asked(spark, sf_dir).where("text is not null").select("id", F.sha2(F.concat_ws("\n", F.lit(VERSION), F.lit("all"), focus(t), normalised_question(t), F.lit("")), 256).alias("key"))


@REGISTRY(f"""with {retrieval._SCORED}, top as (select doc_id, ordinal from scored order by score desc, doc_id, ordinal limit 14), e as (select distinct doc_id || ':' || ordinal || ':' || md5(text) as e from top join documents using (doc_id))
select sha256('{VERSION}' || chr(10) || string_agg(e, chr(10) order by e)) as fingerprint, count(*)::bigint as n from e""")
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer rests on, as one digest: it changes when a document behind it does.  Fourteen passages at most."""
    docs = table(spark, sf_dir, "documents")
    top = retrieval.scored(retrieval.passages(docs), retrieval.TERMS).orderBy(F.desc("score"), "doc_id", "ordinal").limit(14).select("doc_id", "ordinal")
    e = docs.join(F.broadcast(top), "doc_id").select(F.concat_ws(":", "doc_id", "ordinal", F.md5("text")).alias("e")).distinct()
    return e.agg(F.sha2(F.concat_ws("\n", F.lit(VERSION), F.array_join(F.array_sort(F.collect_list("e")), "\n")), 256).alias("fingerprint"), F.count("*").alias("n"))


@REGISTRY(f"""with {_CORPUS} select doc_id, case when text = '' then 'empty' when quality is null then 'unavailable' when toxic = 1 then 'failed' when dated >= timestamp '2024-01-01' or dated is null then 'stale' else 'fresh' end as status from corpus left join labels using (doc_id)""")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kept answer is worth: empty without evidence, unavailable without a writer, failed, stale after a change, else fresh."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    changed = (F.col("dated") >= F.lit("2024-01-01").cast("timestamp")) | F.col("dated").isNull()
    status = F.when(F.col("text") == "", "empty").when(F.col("quality").isNull(), "unavailable").when(F.col("toxic") == 1, "failed").when(changed, "stale").otherwise("fresh")
    return corpus(spark, sf_dir).join(l, "doc_id", "left").select("doc_id", status.alias("status"))


BULLETS_AFTER = 8


@REGISTRY(f"""with m as (select n_name as body, c_name || ' (' || c_mktsegment || ')' as seat, row_number() over (partition by n_name order by c_name) as k, count(*) over (partition by n_name) as n from customer join nation on c_nationkey = n_nationkey)
select body, 0::bigint as place, 'The current ' || body || case when n > {BULLETS_AFTER} then ':' when n = 1 then ' is ' || min(seat) || '.' when n = 2 then ' is ' || string_agg(seat, ' and ' order by k) || '.'
 else ' is ' || string_agg(seat, ', ' order by k) filter (k < n) || ', and ' || max(seat) filter (k = n) || '.' end as line from m where k <= {BULLETS_AFTER} or n <= {BULLETS_AFTER} group by body, n
union all select body, k, '- ' || seat from m where n > {BULLETS_AFTER}""")
def roster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sits in each body, as lines: a sentence for up to eight, a heading and a line a member beyond, so no row grows with a body."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select(F.col("n_name").alias("body"), F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("seat"), F.row_number().over(Window.partitionBy("n_name").orderBy("c_name")).cast("long").alias("k"), F.count("*").over(Window.partitionBy("n_name")).alias("n"))
    g = m.where(F.col("k") <= BULLETS_AFTER).groupBy("body", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "seat"))), lambda x: x["seat"]).alias("s"))
    last, rest = F.element_at("s", -1), F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), ", ")
    said = F.when(F.col("n") > BULLETS_AFTER, ":").when(F.col("n") == 1, F.concat(F.lit(" is "), last, F.lit("."))).when(F.col("n") == 2, F.concat(F.lit(" is "), rest, F.lit(" and "), last, F.lit("."))).otherwise(F.concat(F.lit(" is "), rest, F.lit(", and "), last, F.lit(".")))
    heads = g.select("body", F.lit(0).cast("long").alias("place"), F.concat(F.lit("The current "), "body", said).alias("line"))
    return heads.unionByName(m.where(F.col("n") > BULLETS_AFTER).select("body", F.col("k").alias("place"), F.concat(F.lit("- "), "seat").alias("line")))
