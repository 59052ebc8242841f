"""Free-text retrieval: ranked passages, coverage, caps per document, and retrieval by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions import text as rules
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: The question that the registered queries ask; each term is a concept.
TERMS = ("that", "anon", "ention", "heon", "retion", "tionre")
NOISE = ("a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "what", "when", "which", "who", "why", "with")
CANDIDATES, TOTAL, PER_DOCUMENT = 240, 14, 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def passages(docs: DataFrame) -> DataFrame:
    """One row a line of text: (doc_id, ordinal from 0, content)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))


def scored(rows: DataFrame, terms: tuple[str, ...], content: str = "content") -> DataFrame:
    """``rows`` that hold any term, with tf, matched and score = (tf/(tf+10) + matched) / (terms + 1).

    The score has no shuffle: it is an expression over one row's tokens.
    """
    wanted = F.array(*[F.lit(t) for t in terms])
    t = rows.withColumn("_t", tokens(F.col(content)))
    t = t.withColumn("matched", F.size(F.array_intersect("_t", wanted)).cast("long")).where("matched > 0")
    t = t.withColumn("tf", F.size(F.filter("_t", lambda x: x.isin(*terms))).cast("long"))
    tf = F.col("tf").cast("double")
    return t.withColumn("score", (tf / (tf + 10) + F.col("matched")) / (len(terms) + 1)).drop("_t")


_LIST = ", ".join(f"'{t}'" for t in TERMS)
_LINES = "lines as (select doc_id, unnest(range(len(s)))::int as ordinal, unnest(s) as content from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))"
_SCORED = f"""{_LINES},
tok as (select doc_id, ordinal, regexp_extract_all(lower(content), '[a-z0-9]+') as t from lines),
hits as (select doc_id, ordinal, len(list_intersect(list_distinct(t), [{_LIST}]))::bigint as matched, len(list_filter(t, lambda x: x in ({_LIST})))::bigint as tf from tok),
scored as (select *, (tf::double / (tf::double + 10) + matched) / {len(TERMS) + 1} as score from hits where matched > 0)"""


@REGISTRY(f"with {_SCORED} select doc_id, ordinal, matched, tf, score from scored order by score desc, doc_id, ordinal limit {CANDIDATES}")
def search_ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages for the question: a scan, one expression and a top-k, without a full sort."""
    return scored(passages(table(spark, sf_dir, "documents")), TERMS).select("doc_id", "ordinal", "matched", "tf", "score").orderBy(F.desc("score"), "doc_id", "ordinal").limit(CANDIDATES)


@REGISTRY(f"""with {_SCORED}, best as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from scored)
select doc_id, ordinal, score from best where k <= {PER_DOCUMENT} order by score desc, doc_id, ordinal limit {TOTAL}""")
def search_top_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three passages a document, fourteen in all."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")
    return scored(passages(table(spark, sf_dir, "documents")), TERMS).withColumn("k", F.row_number().over(w)).where(F.col("k") <= PER_DOCUMENT).orderBy(F.desc("score"), "doc_id", "ordinal").limit(TOTAL).select("doc_id", "ordinal", "score")


@REGISTRY(f"""select doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), [{_LIST}]))::bigint as covered from documents where text is not null""")
def search_coverage_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the question's terms each document holds: the correlated count as an array intersection."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(F.array_intersect(tokens(F.col("text")), F.array(*[F.lit(t) for t in TERMS]))).cast("long").alias("covered"))


_NOISE = ", ".join(f"'{t}'" for t in NOISE)


@REGISTRY(rf"""with t as (select conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2 and x not in ({_NOISE})) as w from conversations where role = 'user'),
p as (select conv_id, turn, unnest(w) as x, unnest(range(len(w))) as i from t), f as (select conv_id, turn, x, min(i) as i from p group by all),
k as (select *, row_number() over (partition by conv_id, turn order by i) as n from f)
select t.conv_id, t.turn, coalesce(string_agg(x, ' ' order by i) filter (n <= 24), '') as terms from t left join k on t.conv_id = k.conv_id and t.turn = k.turn group by t.conv_id, t.turn""")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 24 distinct terms of a question, without noise words, in order of first use."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    kept = F.filter(tokens(F.col("text")), lambda x: (F.length(x) >= 2) & ~x.isin(*NOISE))
    return q.select("conv_id", "turn", F.coalesce(F.array_join(F.slice(F.array_distinct(kept), 1, 24), " "), F.lit("")).alias("terms"))


@REGISTRY("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as dated, false as outside from orders
where o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1997-06-01' order by o_orderdate desc, o_orderkey limit 40""")
def search_period_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated in a half-open period, newest first, at most forty."""
    return _in_period(table(spark, sf_dir, "orders"), "1997-03-01", "1997-06-01")


def _in_period(rows: DataFrame, start: str, end: str) -> DataFrame:
    at = F.col("o_orderdate")
    hit = rows.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
    return hit.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dated"), F.lit(False).alias("outside"))


@REGISTRY("""with inside as (select count(*) as n from orders where o_orderdate >= timestamp '2003-01-01' and o_orderdate < timestamp '2003-02-01')
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as dated, true as outside from orders, inside where n = 0
order by least(abs(date_diff('day', o_orderdate::date, date '2003-01-01')), abs(date_diff('day', o_orderdate::date, date '2003-02-01'))), o_orderkey limit 6""")
def search_nearest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six documents nearest to a period that holds none, marked as outside it."""
    rows = table(spark, sf_dir, "orders")
    start, end = F.lit("2003-01-01"), F.lit("2003-02-01")
    inside = rows.where((F.col("o_orderdate") >= start.cast("timestamp")) & (F.col("o_orderdate") < end.cast("timestamp"))).limit(1).select(F.lit(1).alias("some"))
    away = F.least(F.abs(F.datediff("o_orderdate", start.cast("date"))), F.abs(F.datediff("o_orderdate", end.cast("date"))))
    nearest = rows.orderBy(away, "o_orderkey").limit(6).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dated"), F.lit(True).alias("outside"))
    return nearest.join(inside, how="left_anti")


#: A quote shorter than this must stand once, or it tells no place.
UNIQUE_BELOW = 40
FOUND_SQL = "(strpos({t}, {q}) > 0 and {q} <> '' and (length({q}) >= 40 or strpos(substr({t}, strpos({t}, {q}) + 1), {q}) = 0))"


def found(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, and only once if it is short."""
    at = F.instr(text, quote)
    again = F.instr(F.substring(text, at + 1, F.length(text)), quote)
    return (at > 0) & (quote != "") & ((F.length(quote) >= UNIQUE_BELOW) | (again == 0))


def grams(text: Column) -> Column:
    """The distinct keys by which a quote meets a text that holds it: runs of three characters, or single ones of shorter quotes."""
    n = F.length(text)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(runs(1), runs(3)))))


def held_quotes(spark: SparkSession, sf_dir: str, fold=lambda c: c) -> DataFrame:
    """(item_id, doc_id, quote, text) of quotes and texts that may hold them, both folded; texts and quotes are never paired one by one.

    A quote with a word between two others meets the texts that hold its longest such word.  Shorter quotes can be parts of
    words, so they meet texts by a run of three characters.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fold(F.col("text")).alias("text"))
    quotes = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", fold(F.col("text")).alias("quote")).where("quote <> ''")
    white = F.lit(r"[^ \t\n\r\f]+")
    words = F.regexp_extract_all("quote", white, F.lit(0))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))  # the first and last may be parts of words in a text
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    quotes = quotes.withColumn("word", longest)
    by_word = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", white, F.lit(0)))).alias("word")).join(quotes.where("word is not null"), "word").select("doc_id", "item_id", "quote")
    short = quotes.where("word is null").select("item_id", "quote", F.substring("quote", F.lit(1), F.when(F.length("quote") >= 3, 3).otherwise(1)).alias("gram"))
    by_gram = docs.select("doc_id", F.explode(grams(F.col("text"))).alias("gram")).join(short, "gram").select("doc_id", "item_id", "quote") if not short.isEmpty() else None
    held = by_word if by_gram is None else by_word.unionByName(by_gram)
    return held.join(docs, "doc_id")


@REGISTRY(f"""select item_id, doc_id, (strpos(d.text, b.text) - 1)::bigint as start_at, (strpos(d.text, b.text) - 1 + length(b.text))::bigint as end_at
from benchmark b, documents d where {FOUND_SQL.format(t='d.text', q='b.text')}""")
def anchor_exact_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quoted text stands in each document, in code points."""
    at = F.expr("instr(text, quote)")
    return held_quotes(spark, sf_dir).where(found(F.col("text"), F.col("quote"))).select("item_id", "doc_id", (at - 1).cast("long").alias("start_at"), (at - 1 + F.length("quote")).cast("long").alias("end_at"))


def folded(text: Column) -> Column:
    """Text for lenient matching: quotes, dashes and odd blanks as plain ones, marks dropped, white space collapsed, lower case."""
    plain = F.translate(text, "".join(rules.FOLDS), "".join(rules.FOLDS.values()))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*_`#\\]", ""), r"\s+", " ")))


@REGISTRY()
def anchor_normalised_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes found exactly or, where not at all, after folding both sides; places are those in the text as it stands.

    Candidates meet by words of the folded texts; the places are then read off the text itself, an Arrow batch at a time.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("as_quoted"))
    near = held_quotes(spark, sf_dir, folded).where("instr(text, quote) > 0").select("item_id", "doc_id").join(docs, "doc_id").join(quotes, "item_id")

    def run(batches):
        for frame in batches:
            spans = [rules.find_quote(t, q) for t, q in zip(frame["whole"], frame["as_quoted"], strict=True)]
            out = frame[["item_id", "doc_id"]].assign(start_at=[s[0] if s else -1 for s in spans], end_at=[s[1] if s else -1 for s in spans])
            yield out[out["start_at"] >= 0]

    return near.select("item_id", "doc_id", "whole", "as_quoted").mapInPandas(run, "item_id long, doc_id long, start_at long, end_at long")
