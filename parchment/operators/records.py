"""Facts that documents state: sessions, dates, meetings, offices, votes, mentions, findings; and the upkeep of what is derived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators import orders
from parchment.functions.unicode import nfkc
from parchment.plans.registry import Registry
from parchment.sources.scratch import cut
from parchment.sources.tables import table

REGISTRY = Registry()

#: Fixed value: the session that began in a year is the year less this.
BEFORE_FIRST = 1912
MINUTES = r"\bminutes\b|\bmins\b"
MEETING = r"\bmeetings?\b|\bminutes\b|\bmins\b|\bagenda\b|\bgbm\b|general body"
#: Bodies by the words that name them, the first that fits.
BODIES = (("judicial", "judicial|judiciary"), ("executive", r"\bexec(?:utive)?\b|\bexective\b"), ("senate", r"\bsenate\b|general body|\bgbm\b"))
OUTSIDE = r"\badvis[oe]rs?\b|\bdeans?\b|\bprovost\b|\bprof(?:essor)?s?\b|board of trustees"


def session_of(date: Column) -> Column:
    """The session a day falls in: sessions turn over in June."""
    return (F.year(date) - F.when(F.month(date) < 6, 1).otherwise(0) - BEFORE_FIRST).cast("int")


def named_sessions(text: Column) -> Column:
    """The distinct sessions that a text names by their ordinal."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(\d{1,3})(?:st|nd|rd|th)\s+(?:legislative\s+)?session\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda s: s.between(1, 300)))


_TITLES = """titles as (select o_orderkey as id, o_orderdate as created, 'dir/' || case o_custkey % 4 when 0 then 'Minutes' when 1 then 'Agendas' when 2 then 'committees/Health & Safety' else 'misc' end as folder,
 case o_orderkey % 6 when 0 then 'Senate Meeting ' || (o_custkey % 40) when 1 then 'Exec minutes ' || strftime(o_orderdate, '%m/%d/%Y') when 2 then '112th Senate agenda #' || (o_custkey % 9) when 3 then 'Judiciary Minutes template'
 when 4 then 'Dean of Students meeting minutes ' || (o_custkey % 30) else 'Summer Executive Meeting minutes ' || (o_custkey % 12) end as title,
 'Report of the ' || (100 + o_custkey % 15) || 'th session' || case when o_custkey % 4 = 0 then ' and the 108th legislative session' else '' end as opening from orders)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under titles, folders and openings like those of an archive of meetings."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    says = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    folder = F.when(c % 4 == 0, "Minutes").when(c % 4 == 1, "Agendas").when(c % 4 == 2, "committees/Health & Safety").otherwise("misc")
    title = (
        F.when(k % 6 == 0, says("Senate Meeting ", c % 40)).when(k % 6 == 1, says("Exec minutes ", F.date_format("o_orderdate", "MM/dd/yyyy"))).when(k % 6 == 2, says("112th Senate agenda #", c % 9))
        .when(k % 6 == 3, "Judiciary Minutes template").when(k % 6 == 4, says("Dean of Students meeting minutes ", c % 30)).otherwise(says("Summer Executive Meeting minutes ", c % 12)))
    opening = says("Report of the ", 100 + c % 15, "th session", F.when(c % 4 == 0, " and the 108th legislative session").otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").alias("created"), F.concat(F.lit("dir/"), folder).alias("folder"), title.alias("title"), opening.alias("opening"))


_SESSION = "(year({0}) - case when month({0}) < 6 then 1 else 0 end - 1912)::int"


@REGISTRY(f"""with {_TITLES}, n as (select id, created, list_distinct(list_transform(regexp_extract_all(opening, '(?i)\\b(\\d{{1,3}})(?:st|nd|rd|th)\\s+(?:legislative\\s+)?session\\b', 1), lambda x: x::int)) as s from titles)
select id, case when len(s) = 1 then s[1] when len(s) > 1 then 111 else {_SESSION.format('created')} end::int as session from n""")
def document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one session a document names, the inherited one where it names several, else that of its date."""
    t = titles(spark, sf_dir).withColumn("s", named_sessions(F.col("opening")))
    return t.select("id", F.when(F.size("s") == 1, F.col("s")[0]).when(F.size("s") > 1, F.lit(111)).otherwise(session_of(F.col("created"))).alias("session"))


def meeting_role(title: Column, folder: Column) -> Column:
    """minutes, agenda or nothing: the folder says it if it says one of both, else the title."""
    said, planned = folder.rlike("(?i)minutes"), folder.rlike("(?i)agenda")
    return F.when(said & ~planned, "minutes").when(planned & ~said, "agenda").when(title.rlike(f"(?i){MINUTES}"), "minutes").when(title.rlike(r"(?i)\bagenda\b"), "agenda").otherwise("")


def meeting_body(title: Column, folder: Column) -> Column:
    """The body whose meeting a title names, else the committee of its folder, else a body that either mentions."""
    summer = lambda body, where: F.concat(F.lit(body), F.when(F.lit(body == "executive") & F.lower(where).rlike(r"\bsummer\b|\bsum\b"), ":summer").otherwise(""))
    both = F.concat_ws("/", folder, title)
    names = title.rlike(f"(?i){MEETING}") & ~title.rlike(r"(?i)\bcommi?t+ee\b")
    titled, mentioned = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for body, p in BODIES:
        titled = titled.when(names & F.lower(title).rlike(p), summer(body, both))
        mentioned = mentioned.when(F.lower(both).rlike(p), summer(body, both))
    committee = F.trim(F.regexp_replace(F.lower(F.regexp_extract(folder, r"(?i)(?:^|/)(?:\d+_)?committees/([^/]+)", 1)), "[^a-z0-9]+", " "))
    return F.coalesce(titled, F.when(committee != "", F.concat(F.lit("committee:"), committee)), mentioned)


def meeting_ordinal(title: Column) -> Column:
    """The date in a title, month first, else the number of its meeting; session ordinals and years aren't numbers."""
    d = lambda k: F.regexp_extract(title, r"\b(\d{1,2})[./_-](\d{1,2})[./_-]((?:19|20)\d{2})\b", k)
    date = F.when(d(3) != "", F.concat_ws("-", d(3), F.lpad(d(1), 2, "0"), F.lpad(d(2), 2, "0")))
    bare = F.regexp_replace(F.regexp_replace(title, r"(?i)\b\d{1,3}(?:st|nd|rd|th)\b", " "), r"\b(?:19|20)\d{2}\b", " ")
    number = F.lit("")
    for p in (r"\b(\d{1,3})\s*$", r"(?i)\b(?:meeting|gbm|minutes|mins|session|no\.?|number)\s*#?\s*(\d{1,3})\b", r"#\s*(\d{1,3})\b"):
        n = F.regexp_extract(bare, p, 1)
        number = F.when(n != "", n).otherwise(number)
    value = F.when(number != "", number.cast("int"))
    return F.coalesce(date, F.when(value.between(1, 200), value.cast("string")))


_BOTH = "lower(folder || '/' || title)"
_BODY_OF = lambda where, what: " ".join(f"when {where} and regexp_matches({what}, '{p}') then '{b}'" + (f" || case when regexp_matches({_BOTH}, '\\bsummer\\b|\\bsum\\b') then ':summer' else '' end" if b == "executive" else "") for b, p in BODIES)
_NAMES = f"(regexp_matches(title, '(?i){MEETING}') and not regexp_matches(title, '(?i)\\bcommi?t+ee\\b'))"
_COMMITTEE = "trim(regexp_replace(lower(regexp_extract(folder, '(?i)(?:^|/)(?:\\d+_)?committees/([^/]+)', 1)), '[^a-z0-9]+', ' ', 'g'))"
_DATE_RE = "\\b(\\d{1,2})[./_-](\\d{1,2})[./_-]((?:19|20)\\d{2})\\b"
_BARE = "regexp_replace(regexp_replace(title, '(?i)\\b\\d{1,3}(?:st|nd|rd|th)\\b', ' ', 'g'), '\\b(?:19|20)\\d{2}\\b', ' ', 'g')"
_NUMBER = f"""coalesce(nullif(regexp_extract({_BARE}, '#\\s*(\\d{{1,3}})\\b', 1), ''), nullif(regexp_extract({_BARE}, '(?i)\\b(?:meeting|gbm|minutes|mins|session|no\\.?|number)\\s*#?\\s*(\\d{{1,3}})\\b', 1), ''), nullif(regexp_extract({_BARE}, '\\b(\\d{{1,3}})\\s*$', 1), ''))"""
_MEETINGS = f"""{_TITLES}, m as (select id, title, folder, case when contains(folder, 'Minutes') then 'minutes' when contains(folder, 'Agenda') then 'agenda' when regexp_matches(title, '(?i)\\bminutes\\b|\\bmins\\b') then 'minutes' when regexp_matches(title, '(?i)\\bagenda\\b') then 'agenda' else '' end as role,
 case {_BODY_OF(_NAMES, 'lower(title)')} when {_COMMITTEE} <> '' then 'committee:' || {_COMMITTEE} {_BODY_OF('true', _BOTH)} end as body,
 coalesce(case when regexp_extract(title, '{_DATE_RE}', 3) <> '' then regexp_extract(title, '{_DATE_RE}', 3) || '-' || lpad(regexp_extract(title, '{_DATE_RE}', 1), 2, '0') || '-' || lpad(regexp_extract(title, '{_DATE_RE}', 2), 2, '0') end,
  case when {_NUMBER}::int between 1 and 200 then {_NUMBER}::int::varchar end) as ordinal, {_SESSION.format('created')} as session from titles
 where not regexp_matches(title, '(?i)\\btemplate\\b|^\\s*copy of\\b') and not regexp_matches(title, '(?i){OUTSIDE}'))"""


@REGISTRY(f"with {_MEETINGS} select id, role, case when ordinal is null then '' else session || ':' || body || ':' || ordinal end as key from m where role <> '' and body is not null")
def meeting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meeting that a title and its folder tell of: session, body, date or number, and its side of the meeting."""
    return meetings(titles(spark, sf_dir)).select("id", "role", "key")


def meetings(rows: DataFrame) -> DataFrame:
    """``rows`` of (id, created, folder, title) that are a meeting's, with role and key; the key is empty where no ordinal is found."""
    t, f = F.col("title"), F.col("folder")
    meant = rows.where(~t.rlike(r"(?i)\btemplate\b|^\s*copy of\b") & ~t.rlike(f"(?i){OUTSIDE}"))
    m = meant.withColumn("role", meeting_role(t, f)).withColumn("body", meeting_body(t, f)).withColumn("ordinal", meeting_ordinal(t)).where("role <> '' and body is not null")
    return m.withColumn("key", F.when(F.col("ordinal").isNull(), "").otherwise(F.concat_ws(":", session_of(F.col("created")).cast("string"), "body", "ordinal")))


@REGISTRY(f"""with {_MEETINGS}, k as (select id, role, session || ':' || body || ':' || ordinal as key from m where role <> '' and body is not null and ordinal is not null)
select key, count(*) filter (role = 'agenda')::bigint as agendas, count(*) filter (role = 'minutes')::bigint as minutes, min(id) filter (role = 'minutes') as first_minutes from k group by key having count(distinct role) = 2""")
def meetings_with_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings of which both sides are held."""
    g = meetings(titles(spark, sf_dir)).where("key <> ''").groupBy("key").agg(F.count_if(F.col("role") == "agenda").alias("agendas"), F.count_if(F.col("role") == "minutes").alias("minutes"), F.min(F.when(F.col("role") == "minutes", F.col("id"))).alias("first_minutes"))
    return g.where("agendas > 0 and minutes > 0")


def clause_date(rows: DataFrame, key: str, rank: str, date: str) -> DataFrame:
    """(key, date): the date of the highest-ranked group of clauses that agrees; groups that don't are passed over."""
    groups = rows.groupBy(key, rank).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).where("lo = hi")
    return groups.groupBy(key).agg(F.max_by("lo", rank).alias(date))


@REGISTRY("""with g as (select l_orderkey, l_linenumber % 3 as rank, min(l_shipdate::date) as d from lineitem group by all having min(l_shipdate::date) = max(l_shipdate::date)) select l_orderkey, max_by(d, rank)::varchar as date from g group by 1""")
def date_from_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that a document's strongest clauses agree on."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("rank"), F.to_date("l_shipdate").alias("date"))
    return clause_date(rows, "l_orderkey", "rank", "date").select("l_orderkey", F.col("date").cast("string").alias("date"))


def template_year_corrected(date: Column, session: Column, created: Column) -> Column:
    """A date outside its session moves one year into it, unless the file was made within a week of it, or it is a day of the
    spring turnover that the file's making doesn't support."""
    moved = lambda n: F.add_months(date, 12 * n)
    shifted = F.when(session_of(moved(1)) == session, moved(1)).when(session_of(moved(-1)) == session, moved(-1))
    near = lambda d: F.coalesce(F.abs(F.datediff(d, created)) <= 7, F.lit(False))
    turnover = F.month(date).between(4, 6)
    return F.when(session.isNull() | (session_of(date) == session) | shifted.isNull() | near(date), date).when(near(shifted) | ~turnover, shifted).otherwise(date)


_MOVED = "(d + interval ({0} || ' year'))::date"
_SHIFTED = "case when {s1} = session then {m1} when {s2} = session then {m2} end".format(m1="(d + interval 1 year)::date", m2="(d - interval 1 year)::date", s1=_SESSION.format("(d + interval 1 year)"), s2=_SESSION.format("(d - interval 1 year)"))


@REGISTRY(f"""with r as (select o_orderkey, o_orderdate::date as d, {_SESSION.format('o_orderdate')} + (o_orderkey % 3 - 1)::int as session, o_orderdate::date + ((o_orderkey * 13) % 800 - 400)::int as created from orders), s as (select *, {_SHIFTED} as shifted from r)
select o_orderkey, (case when {_SESSION.format('d')} = session or shifted is null or abs(d - created) <= 7 then d when abs(shifted - created) <= 7 or month(d) not between 4 and 6 then shifted else d end)::varchar as date from s""")
def corrected_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates whose year was left over from the template they were copied from."""
    d = F.to_date("o_orderdate")
    r = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), (session_of(d) + (F.col("o_orderkey") % 3 - 1).cast("int")).alias("session"), F.date_add(d, ((F.col("o_orderkey") * 13) % 800 - 400).cast("int")).alias("created"))
    return r.select("o_orderkey", template_year_corrected(F.col("d"), F.col("session"), F.col("created")).cast("string").alias("date"))


@REGISTRY("""with c as (select l_orderkey, l_linenumber % 3 as rank, min(l_shipdate::date) as d from lineitem group by all having min(l_shipdate::date) = max(l_shipdate::date)), k as (select l_orderkey, max_by(d, rank) as d from c group by 1)
select o_orderkey, coalesce(case when o_orderkey % 7 = 0 then date '2000-01-01' end, case when o_orderkey % 2 = 0 then d end, case when o_custkey % 3 = 0 then o_orderdate::date end, case when o_custkey % 5 <> 0 then (o_orderdate + interval 9 day)::date end)::varchar as dated,
 case when o_orderkey % 7 = 0 then 'corrected' when o_orderkey % 2 = 0 and d is not null then 'clause' when o_custkey % 3 = 0 then 'title' when o_custkey % 5 <> 0 then 'byline' else 'none' end as how from orders left join k on l_orderkey = o_orderkey""")
def document_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each document and where it comes from: a correction, its clauses, its title, its byline."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("rank"), F.to_date("l_shipdate").alias("d"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(clause_date(rows, "l_orderkey", "rank", "d"), k == F.col("l_orderkey"), "left")
    given = (("corrected", F.when(k % 7 == 0, F.lit("2000-01-01").cast("date"))), ("clause", F.when(k % 2 == 0, F.col("d"))), ("title", F.when(c % 3 == 0, F.to_date("o_orderdate"))), ("byline", F.when(c % 5 != 0, F.date_add(F.to_date("o_orderdate"), 9))))
    how = reduce(lambda w, g: w.when(g[1].isNotNull(), g[0]), given[1:], F.when(given[0][1].isNotNull(), given[0][0])).otherwise("none")
    return o.select("o_orderkey", F.coalesce(*[d for _, d in given]).cast("string").alias("dated"), how.alias("how"))


# --- people and offices --------------------------------------------------------------------------------------------


@REGISTRY("""with p as (select p_partkey, trim(regexp_replace(unnest(string_split_regex(trim(x), '\\s*&\\s*')), '\\s+', ' ', 'g')) as office, unnest(range(len(string_split_regex(trim(x), '\\s*&\\s*')))) as i from (select p_partkey, p_type || case when p_size % 2 = 0 then ' & ' || p_brand else '' end || case when p_size % 3 = 0 then ' &  ' || lower(p_type) else '' end as x from part)),
f as (select p_partkey, lower(office) as key, min(i) as i, min_by(office, i) as office from p where office <> '' group by all) select p_partkey, string_agg(office, '; ' order by i) as offices from f group by 1""")
def split_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offices of a cell, parted at "&", each once whatever its case."""
    also = lambda n, c: F.when(F.col("p_size") % n == 0, c).otherwise("")
    cell = F.concat("p_type", also(2, F.concat(F.lit(" & "), "p_brand")), also(3, F.concat(F.lit(" &  "), F.lower("p_type"))))
    p = table(spark, sf_dir, "part").select("p_partkey", F.filter(F.transform(F.split(F.trim(cell), r"\s*&\s*"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "").alias("o"))
    first = F.filter("o", lambda x, i: ~F.exists(F.slice("o", F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return p.select("p_partkey", F.array_join(first, "; ").alias("offices"))


@REGISTRY("""with l as (select n_name as office, c_name as name, row_number() over (partition by upper(n_name) order by c_acctbal desc, c_custkey) as k, c_custkey from customer join nation on c_nationkey = n_nationkey where c_mktsegment <> 'MACHINERY')
select office, name, c_custkey as from_document from l where k = 1""")
def officer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office lines of minutes, newest first: the first document decides an office; placeholders are no names."""
    n = F.broadcast(table(spark, sf_dir, "nation"))
    lines = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    best = lines.groupBy(F.upper("n_name").alias("key")).agg(F.min_by(F.struct("n_name", "c_name", "c_custkey"), F.struct(-F.col("c_acctbal"), "c_custkey")).alias("x"))
    return best.select(F.col("x.n_name").alias("office"), F.col("x.c_name").alias("name"), F.col("x.c_custkey").alias("from_document"))


@REGISTRY("""with h as (select o_custkey as person, o_orderpriority as office, year(o_orderdate) as term from orders where o_orderstatus <> 'P' group by all), m as (select max(term) as now from h)
select person, office, min(term)::int as since, case when max(term) = (select now from m) then null else max(term) + 1 end::int as until, count(*)::bigint as terms from h group by all""")
def office_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offices held over time: open while the current term has them, else closed after the last."""
    h = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("office"), F.year("o_orderdate").alias("term")).distinct()
    now = h.agg(F.max("term").alias("now"))
    g = h.groupBy("person", "office").agg(F.min("term").alias("since"), F.max("term").alias("last"), F.count("*").alias("terms")).crossJoin(F.broadcast(now))  # one row
    return g.select("person", "office", F.col("since").cast("int").alias("since"), F.when(F.col("last") < F.col("now"), F.col("last") + 1).cast("int").alias("until"), "terms")


@REGISTRY(f"""with {orders.PEOPLE_SQL}, n as (select o_custkey, count(distinct o_orderkey)::bigint as documents from orders where o_orderstatus <> 'P' group by 1)
select c_custkey, name, coalesce(documents, 0) as documents from people left join n on c_custkey = o_custkey where length(regexp_replace(name, '[^ ]', '', 'g')) >= 1 and (coalesce(documents, 0) >= 1 or c_nationkey = 3)""")
def regular_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People under a full name with a document at least, or with a seat, and their distinct documents."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("documents"))
    p = orders.people(spark, sf_dir).join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))
    return p.where(F.col("name").contains(" ") & ((F.col("documents") >= 1) | (F.col("c_nationkey") == 3))).select("c_custkey", "name", "documents")


@REGISTRY("""with c as (select o_custkey, o_orderkey, o_orderpriority = '1-URGENT' as by_office, o_totalprice > 300000 as in_full, o_orderstatus = 'F' as serving from orders),
a as (select o_custkey, count(*) as n, count(*) filter (by_office) as a, count(*) filter (in_full) as b, count(*) filter (serving) as c, min(o_orderkey) as the_one, min(o_orderkey) filter (by_office) as ia, min(o_orderkey) filter (in_full) as ib, min(o_orderkey) filter (serving) as ic from c group by 1)
select o_custkey, case when n = 1 then the_one when a = 1 then ia when b = 1 then ib when c = 1 then ic end as settled, case when n = 1 then 'only' when a = 1 then 'office' when b = 1 then 'named in full' when c = 1 then 'serving' else 'open' end as how from a""")
def narrowed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several candidates for a short name, narrowed by the first test that leaves exactly one; one aggregate for all tests."""
    tests = (("only", F.lit(True)), ("office", F.col("o_orderpriority") == "1-URGENT"), ("named in full", F.col("o_totalprice") > 300000), ("serving", F.col("o_orderstatus") == "F"))
    aggs = [x for i, (_, t) in enumerate(tests) for x in (F.count_if(t).alias(f"n{i}"), F.min(F.when(t, F.col("o_orderkey"))).alias(f"k{i}"))]
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*aggs)
    pick = reduce(lambda w, i: w.when(F.col(f"n{i}") == 1, F.col(f"k{i}")), range(1, len(tests)), F.when(F.col("n0") == 1, F.col("k0")))
    how = reduce(lambda w, i: w.when(F.col(f"n{i}") == 1, tests[i][0]), range(1, len(tests)), F.when(F.col("n0") == 1, "only")).otherwise("open")
    return g.select("o_custkey", pick.alias("settled"), how.alias("how"))


#: Forms of names to look for in texts, with the languages whose documents they may be used in.
FORMS = (("f1", "Thtieding", None), ("f2", "Onhe", None), ("f3", "The", "en"), ("f4", "La", "fr"), ("f5", "haedea", None))


_MENTIONED = " union all ".join(f"select doc_id, '{f}' as form, line from p where regexp_matches(content, '(^|[^\\p{{L}}]){w}($|[^\\p{{L}}])')" + (f" and lang = '{lang}'" if lang else "") for f, w, lang in FORMS)


@REGISTRY(f"""with l as (select doc_id, lang, string_split(text, chr(10)) as s from documents where text is not null and coalesce(source, '') <> 'news'),
p as (select doc_id, lang, unnest(range(len(s)))::int as line, unnest(s) as content from l) select doc_id, form, min(line)::int as line from ({_MENTIONED}) group by all""")
def reviewed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document that writes a reviewed form, between letters of no word, where the form may be used.

    The forms are a fixed list, so each is an expression over the lines and nothing is joined.
    """
    d = table(spark, sf_dir, "documents").where("text is not null and coalesce(source, '') <> 'news'")
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    written = lambda word, lang: F.col("content").rlike(rf"(?<!\p{{L}}){word}(?!\p{{L}})") & (F.lit(lang is None) | (F.col("lang") == F.lit(lang or "")))
    found = F.array_compact(F.array(*[F.when(written(w, lang), f) for f, w, lang in FORMS]))
    return lines.select("doc_id", "line", F.explode(found).alias("form")).groupBy("doc_id", "form").agg(F.min("line").alias("line"))


# --- votes ---------------------------------------------------------------------------------------------------------

_REGISTER = """reg as (select l_orderkey as file, 'S.B.' || l_linenumber || ' | Act ' || l_partkey || case when l_partkey % 2 = 0 then '.docx' else '' end as title, case l_returnflag when 'A' then 'Passed' when 'R' then 'Tabled indefinitely' else '' end as said,
 case when l_partkey % 10 = 0 then '13/45/1999' else strftime(l_shipdate, '%m/%d/%Y') end as voted, case when l_linestatus = 'F' then 2 else 1 end as reading from lineitem)"""
_STATUS = "case when regexp_matches(said, '(?i)^(?:passed|adopted)$') then 'passed' when regexp_matches(said, '(?i)^(?:failed|rejected|lost|tabled(?: indefinitely)?)$') then 'not_passed' else 'unknown' end"
_TITLE_KEY = "trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(title), '(?i)^S[-.\\s]*B\\.[\\d.-]+\\s*\\|\\s*', ''), '(?i)\\.(?:docx?|pdf)$', '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a voting register."""
    title = F.concat(F.lit("S.B."), F.col("l_linenumber").cast("string"), F.lit(" | Act "), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".docx").otherwise(""))
    said = F.when(F.col("l_returnflag") == "A", "Passed").when(F.col("l_returnflag") == "R", "Tabled indefinitely").otherwise("")
    voted = F.when(F.col("l_partkey") % 10 == 0, "13/45/1999").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), title.alias("title"), said.alias("said"), voted.alias("voted"), F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("reading"))


def vote_status(said: Column) -> Column:
    return F.when(said.rlike("(?i)^(?:passed|adopted)$"), "passed").when(said.rlike("(?i)^(?:failed|rejected|lost|tabled(?: indefinitely)?)$"), "not_passed").otherwise("unknown")


# The prefix and the endings that a register's titles carry, and the words of its status cells.
def voting_title_key(title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(title), r"(?i)^S[-.\s]*B\.[\d.-]+\s*\|\s*", ""), r"(?i)\.(?:docx?|pdf)$", "")
    return F.trim(F.regexp_replace(F.lower(nfkc(bare)), r"[^\p{L}\p{N}]+", " "))


def vote_day(voted: Column) -> Column:
    """The day of a register's cell, month first; a day that no calendar has is none."""
    return F.when(voted.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(voted, "M/d/yyyy"))


@REGISTRY(f"with {_REGISTER} select {_TITLE_KEY} as key, {_STATUS} as status, reading::int as reading, count(*)::bigint as n, max(try_strptime(voted, '%m/%d/%Y')::date)::varchar as last from reg group by all")
def voting_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register by title key, status and reading; blank cells establish nothing."""
    r = register(spark, sf_dir).select(voting_title_key(F.col("title")).alias("key"), vote_status(F.col("said")).alias("status"), "reading", vote_day(F.col("voted")).alias("day"))
    return r.groupBy("key", "status", "reading").agg(F.count("*").alias("n"), F.max("day").cast("string").alias("last"))


_NEVER = "0001-01-01"


def decided(register: DataFrame, key: str) -> DataFrame:
    """(key, x): what the register says of a key, as a struct that ``later`` combines: the last reading that decides, the least
    and greatest status at it and at its last day, and whether one is undated; null fields if no row decides.

    One aggregate of maxima a key; rows that say the same meet before the shuffle.
    """
    known = F.col("status") != "unknown"
    day = F.coalesce("day", F.lit(_NEVER).cast("date"))
    at = register.groupBy(key, "reading", day.alias("day")).agg(F.min(F.when(known, F.col("status"))).alias("lo"), F.max(F.when(known, F.col("status"))).alias("hi"))
    at = at.groupBy(key, "reading").agg(F.max(F.when(F.col("lo").isNotNull(), F.struct("day", "lo", "hi"))).alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("lo").isNotNull(), F.col("day"))).alias("first"))
    return at.groupBy(key).agg(F.max_by(F.struct("reading", "lo", "hi", (F.col("first") == F.lit(_NEVER).cast("date")).alias("undated"), "last"), F.when(F.col("lo").isNotNull(), F.col("reading"))).alias("x"))


def later(a: Column, b: Column) -> Column:
    """What two keys say together."""
    last = F.when(a["last"]["day"] > b["last"]["day"], a["last"]).when(a["last"]["day"] < b["last"]["day"], b["last"]).otherwise(F.struct(a["last"]["day"].alias("day"), F.least(a["last"]["lo"], b["last"]["lo"]).alias("lo"), F.greatest(a["last"]["hi"], b["last"]["hi"]).alias("hi")))
    both = F.struct(a["reading"].alias("reading"), F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"), (a["undated"] | b["undated"]).alias("undated"), last.alias("last"))
    return F.when(a["reading"].isNull() | (a["reading"] < b["reading"]), b).when(b["reading"].isNull() | (a["reading"] > b["reading"]), a).otherwise(both)


def verdict(x: Column) -> tuple[Column, Column]:
    """(status, day): unknown if nothing decides, ambiguous if the last day contradicts itself or an undated row another."""
    torn = ((x["lo"] != x["hi"]) & x["undated"]) | (x["last"]["lo"] != x["last"]["hi"])
    status = F.when(x["reading"].isNull(), "unknown").when(torn, "ambiguous").otherwise(x["last"]["lo"])
    return status, F.when(~torn & (x["last"]["day"] > F.lit(_NEVER).cast("date")), x["last"]["day"])


def decide(matches: DataFrame, key: str) -> DataFrame:
    """(key, status, day) of the keys for which a row decides."""
    status, day = verdict(F.col("x"))
    return decided(matches, key).where("x.reading is not null").select(key, status.alias("status"), day.alias("day"))


_BILLS = """select o_orderkey as id, case when o_orderkey % 3 = 0 then o_orderkey else -1 end as file, 'act ' || (o_custkey % 200) as title,
  'S.B. 112-' || (o_orderkey % 50) || ' | ACT ' || ((o_custkey + (case when o_orderpriority = '1-URGENT' then 1 else 0 end)) % 200) || '.pdf' as display from orders"""


@REGISTRY(f"""with {_REGISTER}, r as (select file, {_TITLE_KEY} as key, {_STATUS} as status, try_strptime(voted, '%m/%d/%Y')::date as day, reading from reg), raw as ({_BILLS}),
b as (select id, file, {_TITLE_KEY} as key from raw union select id, file, {_TITLE_KEY} from (select id, file, display as title from raw)),
m as (select b.id, status, day, reading, 0 as tier from (select distinct id, file from b) b join r using (file) union all select b.id, status, day, reading, 1 from b join r using (key)), t as (select id, min(tier) as tier from m group by 1),
k as (select m.* from m join t using (id, tier) where status <> 'unknown'), k2 as (select k.* from k join (select id, max(reading) as reading from k group by 1) using (id, reading)),
l as (select id, max(coalesce(day, date '0001-01-01')) as last, count(distinct status) > 1 and count(*) > count(day) as undated from k2 group by 1),
d as (select id, case when bool_or(undated) or count(distinct status) > 1 then 'ambiguous' else min(status) end as status, case when not (bool_or(undated) or count(distinct status) > 1) then max(day)::varchar end as day from k2 join l using (id) where coalesce(day, date '0001-01-01') = last group by id)
select raw.id, coalesce(status, 'unknown') as status, day from raw left join d using (id)""")
def bill_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills met with the register by file, and only where no row has the file, by either title.

    The register is decided once a file and once a title key, so a bill looks up one row a join, however many rows or bills
    share a key.
    """
    r = register(spark, sf_dir).select("file", voting_title_key(F.col("title")).alias("key"), vote_status(F.col("said")).alias("status"), vote_day(F.col("voted")).alias("day"), "reading")
    custkey, urgent = F.col("o_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    title = F.concat(F.lit("act "), (custkey % 200).cast("string"))
    display = F.concat(F.lit("S.B. 112-"), (F.col("o_orderkey") % 50).cast("string"), F.lit(" | ACT "), ((custkey + urgent) % 200).cast("string"), F.lit(".pdf"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(-1).alias("file"), voting_title_key(title).alias("key"), voting_title_key(display).alias("shown"))
    by_key = decided(r, "key")
    met = b.join(decided(r, "file").select("file", F.col("x").alias("f"), F.lit(True).alias("_linked")), "file", "left").join(by_key.withColumnRenamed("x", "k"), "key", "left").join(by_key.select(F.col("key").alias("shown"), F.col("x").alias("s")), "shown", "left")
    x = F.when(F.col("_linked"), F.col("f")).when(F.col("key") == F.col("shown"), F.col("k")).otherwise(later(F.col("k"), F.col("s")))
    status, day = verdict(F.col("x"))
    return met.withColumn("x", x).select("id", status.alias("status"), day.cast("string").alias("day"))


@REGISTRY("""with p as (select l_partkey as bill, max(l_shipdate) as passed from lineitem where l_returnflag = 'A' group by 1) select bill, strftime(passed, '%Y-%m-%d') as passed_on from p""")
def passed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day on which minutes record the passage of each bill."""
    g = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("bill")).agg(F.max("l_shipdate").alias("d"))
    return g.select("bill", F.date_format("d", "yyyy-MM-dd").alias("passed_on"))


_ENACTED = r"(?i)\bThe Resolution hereby PASSES by a vote of (\d+) to (\d+) with (\d+) abstentions?\b"


@REGISTRY(f"""with t as (select o_orderkey, case o_orderkey % 4 when 0 then 'x The Resolution hereby passes by a vote of XX to XX with XX abstentions' when 3 then 'Passed in committee' else 'So: The Resolution hereby PASSES by a vote of ' || (o_custkey % 30) || ' to ' || (o_orderkey % 25) || ' with ' || (o_custkey % 2) || ' abstentions.' end as text from orders)
select o_orderkey, coalesce(try_cast(regexp_extract(text, '{_ENACTED}', 1) as int) > try_cast(regexp_extract(text, '{_ENACTED}', 2) as int), false) as passed from t""")
def enacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a filled-in enactment line records more votes for than against; templates and committees don't count."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    line = F.concat(F.lit("So: The Resolution hereby PASSES by a vote of "), (c % 30).cast("string"), F.lit(" to "), (k % 25).cast("string"), F.lit(" with "), (c % 2).cast("string"), F.lit(" abstentions."))
    text = F.when(k % 4 == 0, "x The Resolution hereby passes by a vote of XX to XX with XX abstentions").when(k % 4 == 3, "Passed in committee").otherwise(line)
    n = lambda i: F.expr(f"try_cast(v{i} as int)")
    t = table(spark, sf_dir, "orders").select("o_orderkey", *[F.regexp_extract(text, _ENACTED, i).alias(f"v{i}") for i in (1, 2)])
    return t.select("o_orderkey", F.coalesce(n(1) > n(2), F.lit(False)).alias("passed"))


# --- findings ------------------------------------------------------------------------------------------------------


@REGISTRY("""with e as (select event_id, ts, case event_id % 5 when 0 then null when 1 then strftime(ts, '%Y') when 2 then strftime(ts - interval 40 day, '%Y-%m') when 3 then strftime(ts + interval 500 day, '%Y-%m-%d') else strftime(ts - interval 3 day, '%Y-%m-%d') end as stated from events),
s as (select *, case when stated is null then null when length(stated) = 4 then (stated || '-07-01')::date when length(stated) = 7 then (stated || '-15')::date else stated::date end as d, case length(stated) when 4 then 2 when 7 then 1 else 0 end as p from e),
k as (select *, d is null or d > (ts + interval 366 day)::date or (p > 0 and year(ts) = year(d) and (p = 2 or month(ts) = month(d))) as own from s)
select event_id, (case when own then ts::date else d end)::varchar as date, case when own then 'day' when p = 2 then 'year' when p = 1 then 'month' else 'day' end as precision from k""")
def finding_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of a finding and how precise it is: as stated, unless the document's own day lies in that period or a year before it."""
    k, ts = F.col("event_id") % 5, F.col("ts")
    day = lambda c: F.expr(f"ts + interval {c} days")
    stated = F.when(k == 1, F.date_format(ts, "yyyy")).when(k == 2, F.date_format(day(-40), "yyyy-MM")).when(k == 3, F.date_format(day(500), "yyyy-MM-dd")).when(k == 4, F.date_format(day(-3), "yyyy-MM-dd"))
    e = table(spark, sf_dir, "events").select("event_id", "ts", stated.alias("stated")).withColumn("p", F.when(F.length("stated") == 4, 2).when(F.length("stated") == 7, 1).otherwise(0))
    e = e.withColumn("d", F.to_date(F.concat("stated", F.when(F.col("p") == 2, "-07-01").when(F.col("p") == 1, "-15").otherwise(""))))
    inside = (F.col("p") > 0) & (F.year("ts") == F.year("d")) & ((F.col("p") == 2) | (F.month("ts") == F.month("d")))
    own = F.col("d").isNull() | (F.col("d") > F.to_date(day(366))) | inside
    return e.select("event_id", F.when(own, F.to_date("ts")).otherwise(F.col("d")).cast("string").alias("date"), F.when(own, "day").when(F.col("p") == 2, "year").when(F.col("p") == 1, "month").otherwise("day").alias("precision"))


THREADS, EVENT_KINDS = ("view", "click", "other"), ("purchase", "signup", "discussion")


@REGISTRY("""with j as (select event_id, event_type, value, json_extract_string(props, '$.' || (json_keys(props))[1]) as first, len(json_keys(props))::int as n from events where props is not null)
select event_id, n, first, case when event_type in ('view', 'click') then event_type else 'other' end as thread, case when event_type in ('purchase', 'signup') then event_type else 'discussion' end as kind, case when floor(value + 0.5) >= 3 then 3 when floor(value + 0.5) = 2 then 2 else 1 end::int as weight from j""")
def checked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output field by field: known threads and kinds or the fallback, weights clamped to one to three, properties out of JSON."""
    e = table(spark, sf_dir, "events").where("props is not null").withColumn("keys", F.json_object_keys("props"))
    e = e.withColumn("m", F.from_json("props", "map<string,string>"))
    weight, t = F.floor(F.col("value") + 0.5), F.col("event_type")
    clamped = F.when(weight >= 3, 3).when(weight == 2, 2).otherwise(1)
    return e.select("event_id", F.size("keys").alias("n"), F.try_element_at("m", F.get("keys", F.lit(0))).alias("first"), F.when(t.isin(*THREADS[:-1]), t).otherwise(THREADS[-1]).alias("thread"), F.when(t.isin(*EVENT_KINDS[:-1]), t).otherwise(EVENT_KINDS[-1]).alias("kind"), clamped.alias("weight"))


# --- upkeep --------------------------------------------------------------------------------------------------------


@REGISTRY("""with f as (select doc_id, lang, source, n_chars, case when doc_id % 4 = 0 then source else lang end as was_lang, case when doc_id % 6 = 0 then null else source end as was_source from documents)
select doc_id, lang, source from f where lang is distinct from was_lang or source is distinct from was_source""")
def refreshed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchanged files whose listed metadata differs from what is held, nulls compared as values: only those are written."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(k % 4 == 0, F.col("source")).otherwise(F.col("lang")).alias("was_lang"), F.when(k % 6 != 0, F.col("source")).alias("was_source"))
    return d.where(~F.col("lang").eqNullSafe(F.col("was_lang")) | ~F.col("source").eqNullSafe(F.col("was_source"))).select("doc_id", "lang", "source")


@REGISTRY("""select user_id || ':' || strftime(ts, '%Y-%m-%dT%H') as id, max(case event_type when 'purchase' then 1 else 0 end)::int as published, count(*)::bigint as retries from events group by 1""")
def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an occurrence of a revision, however often it is recorded; published is never taken back."""
    key = F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH"))
    return table(spark, sf_dir, "events").groupBy(key.alias("id")).agg(F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("published"), F.count("*").alias("retries"))


@REGISTRY("""with w as (select year(o_orderdate)::int as year, o_orderkey, row_number() over (partition by year(o_orderdate) order by o_orderdate, o_orderkey) as k from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N' and l_quantity > 45) and not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0))
select year, o_orderkey from w where k <= 25""")
def ingest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to fetch next: neither held nor refused before, at most twenty-five a year, oldest first."""
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_quantity > 45").select("l_orderkey")
    refused = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").join(refused, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    w = Window.partitionBy(F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    return o.select(F.year("o_orderdate").alias("year"), "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 25").drop("k")


def changed_only(held: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The derived rows that differ from what is held, or that aren't held."""
    old = held.select(key, *[F.col(c).alias(f"_was_{c}") for c in columns], F.lit(True).alias("_held"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_was_{c}")) for c in columns], F.col("_held").isNotNull())
    return derived.join(old, key, "left").where(~same).select(*derived.columns)


@REGISTRY(f"""with {_MEETINGS}, d as (select id, role, case when ordinal is null then '' else session || ':' || body || ':' || ordinal end as key from m where role <> '' and body is not null) select id, role, key from d where id % 3 = 0 or id % 10 = 1 and key <> ''""")
def rederived_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over all documents that writes only what has changed: here a third aren't held, and some are held without a key."""
    derived = meetings(titles(spark, sf_dir)).select("id", "role", "key")
    held = derived.where("id % 3 <> 0").withColumn("key", F.when(F.col("id") % 10 == 1, "").otherwise(F.col("key")))
    return changed_only(held, derived, "id", ["role", "key"])


@REGISTRY("""with c as (select event_type as was, case when value > 50 then 'purchase' when event_type = 'error' then 'error' else 'view' end as now from events) select was, now, count(*)::bigint as n, count(*) filter (was <> now)::bigint as moved from c group by all""")
def reclassification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a new classification moves, from each kind to each."""
    t = F.col("event_type")
    c = table(spark, sf_dir, "events").select(t.alias("was"), F.when(F.col("value") > 50, "purchase").when(t == "error", "error").otherwise("view").alias("now"))
    return c.groupBy("was", "now").agg(F.count("*").alias("n"), F.count_if(F.col("was") != F.col("now")).alias("moved"))


@REGISTRY(f"""with {orders.PEOPLE_SQL}, a as (select s_suppkey as alias, 'n' || translate(right(s_name, 2), '0123456789', 'aeioungklm') as short from supplier), t as (select lower(split_part(name, ' ', 1)) as given, count(distinct c_custkey) as n from people group by 1)
select alias, short from a left join t on given = short where coalesce(n, 0) <> 1""")
def stale_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names that no longer stand for exactly one person: their stored answers expire."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias"), F.concat(F.lit("n"), F.translate(F.expr("right(s_name, 2)"), "0123456789", "aeioungklm")).alias("short"))
    one = orders.people(spark, sf_dir).groupBy(F.lower(F.split("name", " ", 2)[0]).alias("short")).agg(F.countDistinct("c_custkey").alias("n")).where("n = 1")
    return a.join(one, "short", "left_anti").select("alias", "short")


# --- trees and links -----------------------------------------------------------------------------------------------


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, tag, level): what is reached from ``roots`` (node, tag) along ``edges`` (parent, child), each node once at its
    least level, and there under its least tag.

    A level is one join of the new nodes with the edges; nodes seen before drop out, so cycles end.  Levels are cut from
    each other's lineage in the checkpoint folder.
    """
    front = roots.groupBy("node").agg(F.min("tag").alias("tag")).withColumn("level", F.lit(0))
    front = cut(front)
    seen = front
    for level in range(1, depth + 1):
        following = front.join(edges, F.col("node") == F.col("parent")).groupBy("child").agg(F.min("tag").alias("tag")).select(F.col("child").alias("node"), "tag").join(seen.select("node"), "node", "left_anti")
        front = cut(following.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


FOLDER_DEPTH, LINK_ROUNDS = 10, 2


@REGISTRY(f"""with recursive e as (select p_partkey // 3 as parent, p_partkey as child from part union all select p_partkey, p_partkey // 9 from part where p_partkey % 50 = 0), r as (select p_partkey as node, p_type as tag, 0 as level from part where p_partkey in (1, 2)
 union select child, tag, level + 1 from r join e on node = parent where level < {FOLDER_DEPTH}), b as (select node, min(level) as level from r group by 1)
select r.node, min(tag) as tag, b.level::int as level from r join b on r.node = b.node and r.level = b.level group by r.node, b.level""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files below two roots, breadth first, ten deep; links back up don't loop, and the root's tag is inherited."""
    p = table(spark, sf_dir, "part")
    edges = p.select(F.expr("p_partkey div 3").alias("parent"), F.col("p_partkey").alias("child")).unionByName(p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("parent"), F.expr("p_partkey div 9").alias("child")))
    return walk(edges, p.where("p_partkey in (1, 2)").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("tag")), FOLDER_DEPTH)


@REGISTRY(f"""with recursive e as (select l_orderkey as parent, l_partkey as child from lineitem), r as (select o_orderkey as node, 0 as level from orders where o_orderkey % 100 = 1 union select child, level + 1 from r join e on node = parent where level < {LINK_ROUNDS})
select node, min(level)::int as level from r group by 1""")
def link_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that agendas lead to in two rounds of links."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    roots = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 1").select(F.col("o_orderkey").alias("node"), F.lit("").alias("tag"))
    return walk(edges, roots, LINK_ROUNDS).select("node", "level")


# --- delimited text ------------------------------------------------------------------------------------------------


def delimited_cell(cell: Column, delimiter: str) -> Column:
    """A cell of delimited text: line ends are blanks; commas quote, tabs flatten."""
    clean = F.regexp_replace(cell, "\r\n|[\r\n\f]", " ")
    if delimiter == "\t":
        return F.regexp_replace(clean, "\t", " ")
    return F.when(clean.rlike('[",]'), F.concat(F.lit('"'), F.regexp_replace(clean, '"', '""'), F.lit('"'))).otherwise(clean)


def sheet_delimiter(mime: Column) -> Column:
    """Tabs for office workbooks, commas for other sheets, null for what is no sheet."""
    return F.when(mime.rlike("(?i)spreadsheetml|excel"), "\t").when(mime.rlike("(?i)spreadsheet|csv"), ",")


_CELL = """case when regexp_matches(c, '[",]') then '"' || replace(c, '"', '""') || '"' else c end"""


@REGISTRY(f"""with r as (select doc_id, regexp_replace(text, '\\r\\n|[\\r\\n\\f]', ' ', 'g') as a, regexp_replace(coalesce(source, ''), '\\r\\n|[\\r\\n\\f]', ' ', 'g') as b, case doc_id % 3 when 0 then 'application/vnd.ms-excel' when 1 then 'text/csv' else 'text/plain' end as mime from documents where text is not null)
select doc_id, {_CELL.replace('c', 'a', 0).replace('(c,', '(a,').replace('replace(c', 'replace(a').replace('else c', 'else a')} || ',' || {_CELL.replace('(c,', '(b,').replace('replace(c', 'replace(b').replace('else c', 'else b')} as row, case when regexp_matches(mime, '(?i)spreadsheetml|excel') then 'tab' when regexp_matches(mime, '(?i)spreadsheet|csv') then 'comma' else 'none' end as delimiter from r""")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as delimited text, and the delimiter that a file's type calls for."""
    mime = F.when(F.col("doc_id") % 3 == 0, "application/vnd.ms-excel").when(F.col("doc_id") % 3 == 1, "text/csv").otherwise("text/plain")
    d = table(spark, sf_dir, "documents").where("text is not null")
    row = F.concat(delimited_cell(F.col("text"), ","), F.lit(","), delimited_cell(F.coalesce("source", F.lit("")), ","))
    found = sheet_delimiter(mime)
    return d.select("doc_id", row.alias("row"), F.when(found == "\t", "tab").when(found == ",", "comma").otherwise("none").alias("delimiter"))
