"""Orders of listings and of people: nine document orders, their dates, pages after a cursor, surnames and taxonomies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: The orders of a listing.
SORTS = ("relevant", "modified", "dated", "created", "added", "modified-asc", "dated-asc", "created-asc", "added-asc")
PAGE, LARGEST_PAGE = 30, 100


def default_sort(has_query: bool) -> str:
    return "relevant" if has_query else "modified"


def parse_sort(value: str | None, has_query: bool) -> str:
    """A known order, else the default; relevance needs a query."""
    return value if value in SORTS and (has_query or value != "relevant") else default_sort(has_query)


def page_size(asked: int | None) -> int:
    return PAGE if asked is None else min(max(asked, 1), LARGEST_PAGE)


def listed_date(dated: str = "dated", created: str = "created", modified: str = "modified") -> Column:
    """The date that a document is filed under: its own, else when the file was made, else when it changed."""
    return F.coalesce(dated, created, modified)


def updated_date(dated: str = "dated", created: str = "created", modified: str = "modified") -> Column:
    """When it last changed, else the date it is filed under."""
    return F.coalesce(F.col(modified), listed_date(dated, created, modified))


def sort_date(sort: str) -> Column:
    """The date that an order goes by; "dated", "created" and "added" don't fall back to another."""
    own = {"added": F.col("added"), "dated": F.col("dated"), "created": F.col("created")}
    return own.get(sort.removesuffix("-asc"), updated_date())


def base_letters(text: Column) -> Column:
    """Text as it is compared: case and marks don't count."""
    return F.translate(F.lower(text), "".join(_MARKED), "".join(_MARKED.values()))


#: Latin letters with marks, and the letter under each: by decomposition.
_MARKED = {c: p for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(p := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and p.isascii() and p != c}


def listing_order(sort: str, rank: str = "find_rank", title: str = "title", key: str = "id") -> list[Column]:
    """A total order: rank under "relevant", then the date with undated rows last both ways, title, id."""
    date = F.asc_nulls_last(sort_date(sort)) if sort.endswith("-asc") else F.desc_nulls_last(sort_date(sort))
    return [*([F.desc(rank)] if sort == "relevant" else []), date, base_letters(F.col(title)), F.col(key)]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: some undated, some never modified."""
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.expr(n))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("dated"),
        F.when(F.col("o_custkey") % 5 != 0, day("9")).alias("created"), F.when(F.col("o_orderkey") % 4 != 0, day("cast(o_orderkey % 90 as int)")).alias("modified"),
        F.when(F.col("o_orderkey") % 11 != 0, day("20")).alias("added"), (F.col("o_custkey") % 3 * 100).cast("int").alias("find_rank"))


_LISTING = """l as (select o_orderkey as id, o_orderpriority || ' ' || o_orderstatus as title, case when o_orderkey % 3 <> 0 then o_orderdate end as dated,
case when o_custkey % 5 <> 0 then o_orderdate + interval 9 day end as created, case when o_orderkey % 4 <> 0 then o_orderdate + to_days((o_orderkey % 90)::int) end as modified,
case when o_orderkey % 11 <> 0 then o_orderdate + interval 20 day end as added, (o_custkey % 3 * 100)::int as find_rank from orders)"""
_DATES = {"added": "added", "dated": "dated", "created": "created"}


def _order_sql(sort: str) -> str:
    date = _DATES.get(sort.removesuffix("-asc"), "coalesce(modified, dated, created)")
    return f"{'find_rank desc, ' * (sort == 'relevant')}{date} {'asc' if sort.endswith('-asc') else 'desc'} nulls last, strip_accents(lower(title)), id"


def _by(sort: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = listing(spark, sf_dir).orderBy(*listing_order(sort)).limit(50)
        return top.select(F.row_number().over(Window.orderBy(*listing_order(sort))).alias("place"), "id", F.date_format(sort_date(sort), "yyyy-MM-dd").alias("date"))

    query.__name__ = f"listing_by_{sort.replace('-', '_')}"
    query.__doc__ = f"The first fifty of the order {sort!r}; places are numbered in those fifty."
    order = _order_sql(sort)
    date = _DATES.get(sort.removesuffix("-asc"), "coalesce(modified, dated, created)")
    REGISTRY(f"with {_LISTING} select row_number() over (order by {order})::int as place, id, strftime({date}, '%Y-%m-%d') as date from l order by {order} limit 50")(query)


for _sort in SORTS:
    _by(_sort)


@REGISTRY(f"""with {_LISTING} select id, strftime(coalesce(dated, created, modified), '%Y-%m-%d') as listed, strftime(coalesce(modified, dated, created), '%Y-%m-%d') as updated from l""")
def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date each document is filed under, and the date it last changed."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return listing(spark, sf_dir).select("id", day(listed_date()).alias("listed"), day(updated_date()).alias("updated"))


@REGISTRY(f"with {_LISTING} select id, title from l order by coalesce(modified, dated, created) desc nulls last, strip_accents(lower(title)), id limit 40")
def recently_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty documents that changed last; the id makes the order total."""
    return listing(spark, sf_dir).orderBy(F.desc_nulls_last(updated_date()), base_letters(F.col("title")), "id").limit(40).select("id", "title")


def page_after(rows: DataFrame, order: list[Column], key: str, after, offset: int, limit: int, keys: list[tuple[Column, bool]]) -> DataFrame:
    """The page after the row ``after``; if that has gone, the page that starts one page before ``offset``.

    ``keys`` are the order's expressions with whether each falls, null never first.  The cursor's row is one lookup by id;
    the rows behind it are a filter on their keys, so no row is numbered.
    """
    cursor = rows.where(F.col(key) == F.lit(after)).select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).first()
    if cursor is None:
        return rows.orderBy(*order).offset(max(0, offset - limit)).limit(limit)
    behind, level = F.lit(False), F.lit(True)
    for (k, falls), value in zip(keys, cursor, strict=True):
        at = F.lit(value)
        past = F.lit(False) if value is None else k.isNull() | ((k < at) if falls else (k > at))
        behind = behind | (level & F.coalesce(past, F.lit(False)))
        level = level & k.eqNullSafe(at)
    return rows.where(behind).orderBy(*order).limit(limit)


def modified_keys() -> list[tuple[Column, bool]]:
    return [(updated_date(), True), (base_letters(F.col("title")), False), (F.col("id"), False)]


@REGISTRY(f"""with {_LISTING}, n as (select *, row_number() over (order by {_order_sql('modified')}) as k from l), c as (select k from n where id = 100)
select n.id, n.title from n, c where n.k > c.k and n.k <= c.k + 30""")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty documents after a given one; the titles are fetched for the page alone."""
    rows = listing(spark, sf_dir)
    ids = page_after(rows, listing_order("modified"), "id", 100, 30, page_size(None), modified_keys()).select("id")
    return rows.join(F.broadcast(ids), "id", "left_semi").select("id", "title")  # a page: a hundred rows at most


@REGISTRY(f"with {_LISTING} select id, title from l order by {_order_sql('modified')} limit 30 offset 60")
def listing_page_cursor_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a document that has left the listing: it steps back a page from the offset."""
    return page_after(listing(spark, sf_dir), listing_order("modified"), "id", -1, 90, page_size(None), modified_keys()).select("id", "title")


@REGISTRY(f"with {_LISTING}, seen as (select id from l order by {_order_sql('modified')} limit 45) select id from (select id from l order by {_order_sql('modified')} limit 30 offset 30) where id not in (select id from seen)")
def page_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page without what the reader has seen."""
    rows, order = listing(spark, sf_dir), listing_order("modified")
    return rows.orderBy(*order).offset(30).limit(30).select("id").join(rows.orderBy(*order).limit(45).select("id"), "id", "left_anti")


# --- people --------------------------------------------------------------------------------------------------------

#: What follows a surname.
SUFFIXES = ("III", "II", "IV", "Jr", "Sr")
#: Roles in the order in which they are shown; unknown ones come last.
ROLES = ("1-URGENT", "3-MEDIUM", "2-HIGH", "5-LOW")


def surname(name: Column) -> Column:
    """The last word that isn't a suffix; a hyphen stays inside it."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~w.rlike(rf"(?i)^(?:{'|'.join(SUFFIXES)})\.?$"))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.trim(name))


def surname_order(name: str) -> list[Column]:
    return [base_letters(surname(F.col(name))), base_letters(F.col(name)), F.col(name)]


def name_key(name: Column) -> Column:
    """Names are the same if this is: lower case, marks dropped, anything but letters to one blank."""
    return F.trim(F.regexp_replace(base_letters(F.regexp_replace(name, r"[̀-ͯ]", "")), "[^a-z]+", " "))


def role_place(role: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The place of a role in the taxonomy, from 0; one past the end if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, roles)), role)
    return F.when(place == 0, F.lit(len(roles))).otherwise(place - 1).cast("int")


_DIGITS, _LETTERS, _TAIL = "0123456789", "aeiouéñgkl", "drnmtsbpvz"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names made of their numbers, some with a suffix, some with a hyphen."""
    part = lambda a, n, to: F.translate(F.substring("c_name", a, n), _DIGITS, to)
    given, family = F.concat(F.lit("N"), part(16, 3, _LETTERS)), F.concat(F.lit("S"), part(13, 3, _TAIL), F.when(F.col("c_custkey") % 4 == 0, F.lit("-Ada")).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(given, F.lit(" "), family, F.when(F.col("c_custkey") % 7 == 0, F.lit(" Jr.")).otherwise("")).alias("name"))


PEOPLE_SQL = f"""people as (select c_custkey, c_nationkey, 'N' || translate(substr(c_name, 16, 3), '{_DIGITS}', '{_LETTERS}') || ' S' || translate(substr(c_name, 13, 3), '{_DIGITS}', '{_TAIL}')
 || case when c_custkey % 4 = 0 then '-Ada' else '' end || case when c_custkey % 7 = 0 then ' Jr.' else '' end as name from customer)"""
_SURNAME_SQL = "coalesce(list_last(list_filter(string_split(trim({0}), ' '), lambda w: not regexp_matches(w, '(?i)^(?:III|II|IV|Jr|Sr)\\.?$'))), trim({0}))"
_BY_SURNAME = f"strip_accents(lower({_SURNAME_SQL.format('name')})), strip_accents(lower(name)), name"
_ROLE_SQL = "case o_orderpriority " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(ROLES)) + f" else {len(ROLES)} end"
_KEY_SQL = "trim(regexp_replace(strip_accents(lower({})), '[^a-z]+', ' ', 'g'))"


@REGISTRY(f"with {PEOPLE_SQL} select name, {_SURNAME_SQL.format('name')} as surname, row_number() over (order by {_BY_SURNAME}, c_custkey)::int as place from people order by {_BY_SURNAME}, c_custkey limit 100")
def people_by_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred people of a directory: by surname, then by the whole name."""
    order = [*surname_order("name"), F.col("c_custkey")]
    top = people(spark, sf_dir).orderBy(*order).limit(100)
    return top.select("name", surname(F.col("name")).alias("surname"), F.row_number().over(Window.orderBy(*order)).alias("place"))


@REGISTRY(f"""with {PEOPLE_SQL}, n as (select o_custkey, count(*)::bigint as n from orders where o_orderstatus = 'F' group by 1), j as (select name, n, c_custkey from people join n on c_custkey = o_custkey)
select name, n, row_number() over (order by {_BY_SURNAME}, c_custkey)::int as place from j order by {_BY_SURNAME}, c_custkey limit 200""")
def people_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with a contribution at least, in surname order, with how many: the first two hundred."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    order = [*surname_order("name"), F.col("c_custkey")]
    top = people(spark, sf_dir).join(n, F.col("c_custkey") == F.col("o_custkey")).orderBy(*order).limit(200)
    return top.select("name", "n", F.row_number().over(Window.orderBy(*order)).alias("place"))


@REGISTRY(f"""with c as (select o_orderpriority as role, count(*)::bigint as n, min({_ROLE_SQL})::int as place from orders group by 1) select role, n, place, row_number() over (order by n desc, role)::int as by_count from c""")
def roles_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of each role, with its place in the taxonomy and by count."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.count("*").alias("n"))
    return c.select("role", "n", role_place(F.col("role")).alias("place"), F.row_number().over(Window.orderBy(F.desc("n"), "role")).alias("by_count"))  # a row a role


@REGISTRY(f"""with {PEOPLE_SQL}, k as (select {_KEY_SQL.format('name')} as key, min(c_custkey) as person from people group by 1),
s as (select s_suppkey, 'n' || translate(right(s_name, 3), '{_DIGITS}', 'aeioungkl') as given, upper('  S' || translate(substr(s_name, 13, 3), '{_DIGITS}', '{_TAIL}')) as family from supplier)
select s_suppkey, person from s left join k on {_KEY_SQL.format("given || ' ' || family")} = k.key""")
def contacts_to_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts joined to people by name key; those who match nobody stay, without one."""
    k = people(spark, sf_dir).groupBy(name_key(F.col("name")).alias("key")).agg(F.min("c_custkey").alias("person"))
    given = F.concat(F.lit("n"), F.translate(F.expr("right(s_name, 3)"), _DIGITS, "aeioungkl"))
    family = F.upper(F.concat(F.lit("  S"), F.translate(F.substring("s_name", 13, 3), _DIGITS, _TAIL)))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", name_key(F.concat(given, F.lit(" "), family)).alias("key"))
    return s.join(k, "key", "left").select("s_suppkey", "person")


@REGISTRY(f"""with {PEOPLE_SQL}, r as (select l_orderkey, min(case when o_orderstatus = 'F' then 0 else 1 end) as side, name from lineitem join orders on l_orderkey = o_orderkey join people on c_custkey = (l_suppkey * 7 + l_linenumber) % 150 + 1 group by l_orderkey, name),
f as (select l_orderkey, {_KEY_SQL.format('name')} as key, min(side) as side, min(name) as name from r group by all)
select l_orderkey, string_agg(name, ', ' order by side, {_BY_SURNAME}) as line from f group by 1""")
def author_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authors of each document on one line: introducers before sponsors, by surname, a name key once."""
    p = people(spark, sf_dir).select("c_custkey", "name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("side"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 150 + 1).alias("c_custkey"))  # noqa: E741
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, "c_custkey")
    once = rows.groupBy("l_orderkey", name_key(F.col("name")).alias("key")).agg(F.min("side").alias("side"), F.min("name").alias("name"))
    entry = F.struct("side", *[c.alias(f"k{i}") for i, c in enumerate(surname_order("name"))])
    return once.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["k2"]), ", ").alias("line"))


@REGISTRY(f"""select o_custkey, string_agg(distinct o_orderpriority, ', ' order by {_ROLE_SQL}, o_orderpriority) as roles from (select distinct o_custkey, o_orderpriority from orders) group by 1""".replace(f"string_agg(distinct o_orderpriority, ', ' order by {_ROLE_SQL}, o_orderpriority)", f"string_agg(o_orderpriority, ', ' order by {_ROLE_SQL}, o_orderpriority)"))
def roles_in_taxonomy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a person with the roles held, in the order of the taxonomy."""
    entry = F.struct(role_place(F.col("o_orderpriority")).alias("place"), F.col("o_orderpriority").alias("role"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(entry)).alias("r"))
    return g.select("o_custkey", F.array_join(F.transform("r", lambda x: x["role"]), ", ").alias("roles"))


@REGISTRY("select doc_id, case when lang <> 'en' then lang else coalesce(nullif(left(text, 12), ''), source) end as shown from (select doc_id, text, coalesce(source, '') as source, case when lang = 'en' then 'en' else lang end as lang from documents) where lang is not null")
def shown_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title, or the file's name where the title is empty rather than missing."""
    first = F.substring("text", 1, 12)
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return d.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).when(first != "", first).otherwise(F.coalesce("source", F.lit(""))).alias("shown"))
