"""People out of lines: labelled lists, rosters with sections, directories from several sources, and evidence of passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators import orders
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: Labels at the start of a line and the role that the people after it have.
LABELS = (("introducer", r"(?i)^\W*(?:introduced by|introducers?|authors?)\W*:\s*"), ("sponsor", r"(?i)^\W*(?:sponsored by|sponsors?|co-sponsors?)\W*:\s*"), ("present", r"(?i)^\W*(?:present|in attendance)\W*:\s*"))


def split_people(list_: Column) -> Column:
    """The members of a list, parted at commas, semicolons, "and", "&", slashes and bullets that no parentheses hold."""
    outside = r"(?![^()]*\))"
    parts = F.split(list_, rf"\s*(?:[,;&/•]|\band\b)\s*{outside}")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def people_of_lines(lines: DataFrame, key: str = "doc", line: str = "line", text: str = "text") -> DataFrame:
    """(key, role, name, note, line): people of labelled lines, a name and role once at its first line; what stands in
    parentheses is a note."""
    role, rest = F.when(F.lit(False), ""), F.col(text)
    for name, p in LABELS:
        role = role.when(F.col(text).rlike(p), name)
        rest = F.regexp_replace(rest, p, "")
    people = lines.select(key, line, role.alias("role"), F.explode(split_people(rest)).alias("who")).where("role is not null")
    note = F.regexp_extract("who", r"\(([^()]*)\)", 1)
    named = people.select(key, line, "role", F.trim(F.regexp_replace("who", r"\s*\([^()]*\)", "")).alias("name"), note.alias("note")).where("name <> ''")
    return named.groupBy(key, "role", orders.name_key(F.col("name")).alias("k")).agg(F.min_by(F.struct("name", "note", line), line).alias("x")).select(key, "role", "x.name", "x.note", f"x.{line}")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: says("Ann", F.translate((c + n).cast("string"), "0123456789", "abcdefghij"), " Lee")
    text = (
        F.when(k % 3 == 0, says("Introduced by: ", name(0), ", ", name(1), " (chair, and clerk) and ", name(2), " & ", name(0)))
        .when(k % 3 == 1, says("**Sponsors**: ", name(3), "; ", name(4), " (x/y)")).otherwise(says("They met: ", name(5), ", ", name(6))))
    return table(spark, sf_dir, "orders").select(k.alias("doc"), F.lit(1).alias("line"), text.alias("text"))


_NAME = "'Ann' || translate((o_custkey + {0})::varchar, '0123456789', 'abcdefghij') || ' Lee'"


@REGISTRY(" union all ".join(f"select o_orderkey as doc, '{r}' as role, {_NAME.format(n)} as name, '{note}' as note from orders where o_orderkey % 3 = {m}" for m, r, n, note in ((0, "introducer", 0, ""), (0, "introducer", 1, "chair, and clerk"), (0, "introducer", 2, ""), (1, "sponsor", 3, ""), (1, "sponsor", 4, "x/y"))))
def people_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and roles of labelled lines; lists are parted outside parentheses, and lines without a label name nobody."""
    return people_of_lines(_lines(spark, sf_dir)).select("doc", "role", "name", "note")


def sections_carried(lines: DataFrame, sheet: str, line: str, cells: Column) -> DataFrame:
    """(sheet, line, section, cells): rows of a sheet under the last row above them whose first cell alone is filled."""
    alone = (F.get(cells, F.lit(0)) != "") & F.forall(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), lambda x: x == "")
    marked = lines.withColumn("_cells", cells).withColumn("_head", F.when(alone, F.get("_cells", F.lit(0))))
    section = F.last("_head", ignorenulls=True).over(Window.partitionBy(sheet).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("section", section).where("_head is null").select(sheet, line, "section", F.col("_cells").alias("cells"))


_SHEET = """rows as (select c_nationkey as sheet, c_custkey * 2 as line, c_name as name, c_mktsegment as seat, case when c_custkey % 4 = 0 then '' else lower(c_name) || '@x.org' end as mail from customer),
heads as (select c_nationkey as sheet, c_custkey * 2 - 1 as line, 'Body ' || (c_custkey % 5) as section from customer where c_custkey % 10 < 4)"""


@REGISTRY(f"""with {_SHEET}, u as (select sheet, line, name, seat, mail, null as section from rows union all select sheet, line, null, null, null, section from heads),
c as (select *, last_value(section ignore nulls) over (partition by sheet order by line rows unbounded preceding) as s from u) select sheet, name, seat, mail, coalesce(s, '') as section from c where name is not null""")
def roster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of roster sheets kept as delimited text, each under its section: quoted cells, and sections carried down."""
    says = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    c = table(spark, sf_dir, "customer")
    mail = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(says(F.lower("c_name"), "@x.org"))
    rows = c.select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") * 2).alias("line"), says('"', F.col("c_name"), '", ', F.col("c_mktsegment"), ",", mail).alias("text"))
    heads = c.where("c_custkey % 10 < 4").select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") * 2 - 1).alias("line"), says("Body ", (F.col("c_custkey") % 5).cast("string"), ",,").alias("text"))
    cells = F.transform(F.regexp_extract_all("text", F.lit(r'\s*("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')))
    out = sections_carried(rows.unionByName(heads), "sheet", "line", F.slice(cells, 1, 3))
    return out.select("sheet", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("name", "seat", "mail"))], F.coalesce("section", F.lit("")).alias("section"))


@REGISTRY("""with p as (select o_custkey as person, year(o_orderdate)::int as session, o_orderstatus as src, o_orderpriority as office, o_orderdate as day, o_orderkey as id from orders), rolls as (select session, max(case when src = 'P' then 1 else 0 end) as positions from p group by 1),
roll as (select p.* from p join rolls using (session) where src = case when positions = 1 then 'P' else 'O' end), offices as (select session, person, max_by(office, (day, id)) as office from roll group by all),
mails as (select session, person, count(*) as n from p where src = 'O' group by all)
select o.session, o.person, case when positions = 1 then o.office end as office, coalesce(m.n, 0)::bigint as mails from offices o join rolls r using (session) left join mails m on m.session = o.session and m.person = o.person""")
def directory_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each session by precedence: a positions document alone decides the roll and the offices, and mail lists only
    add addresses to it; without one the mail lists are the roll."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("session"), F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("office"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    per = p.where("src in ('P', 'O')").groupBy("session", "person").agg(F.max_by("office", F.when(F.col("src") == "P", F.col("at"))).alias("office"), F.max(F.col("src") == "P").alias("placed"), F.count_if(F.col("src") == "O").alias("mails"))
    rolls = p.groupBy("session").agg(F.max(F.col("src") == "P").alias("positions"))  # a row a session
    both = per.join(F.broadcast(rolls), "session")
    return both.where(F.when(F.col("positions"), F.col("placed")).otherwise(F.col("mails") > 0)).select("session", "person", F.when(F.col("positions"), F.col("office")).alias("office"), "mails")


@REGISTRY("""with e as (select o_orderkey as bill, 0 as tier, o_orderdate::date as day from orders where o_orderstatus <> 'O' union all select l_orderkey, 1, l_shipdate::date from lineitem where l_returnflag = 'A'),
c as (select * from e where day <= date '1998-03-01'), t as (select bill, min(tier) as tier from c group by 1), d as (select bill, tier, count(distinct day) as n, min(day) as day from c join t using (bill, tier) group by all)
select bill, case when n > 1 then 'ambiguous' when tier = 0 then 'register' else 'minutes' end as evidence, case when n = 1 then day::varchar end as passed from d""")
def passage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells that a bill passed, as of a day: the register before minutes, and nothing certain where records differ."""
    e = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("bill"), F.lit(0).alias("tier"), F.to_date("o_orderdate").alias("day"))
    m = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("bill"), F.lit(1).alias("tier"), F.to_date("l_shipdate").alias("day"))
    known = e.unionByName(m).where(F.col("day") <= F.lit("1998-03-01").cast("date"))
    best = known.groupBy("bill", "tier").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).groupBy("bill").agg(F.min(F.struct("tier", "lo", "hi")).alias("x"))
    torn = F.col("x.lo") != F.col("x.hi")
    return best.select("bill", F.when(torn, "ambiguous").when(F.col("x.tier") == 0, "register").otherwise("minutes").alias("evidence"), F.when(~torn, F.col("x.lo").cast("string")).alias("passed"))


@REGISTRY("""with m as (select conv_id, turn, regexp_extract(text, '([a-z]{5,})', 1) as heading, text, date '2024-01-01' + ((conv_id * 7 + turn * 3) % 200)::int as day from conversations where text is not null)
select conv_id, max_by(turn, (day, turn)) as turn, max(day)::varchar as day, count(*)::bigint as entries from m group by 1""")
def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of the meetings that one file logs, and how many it logs: entries are parted by their headings and dated, a piece
    of the file a row, so that no row grows with a file."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 200).cast("int"))
    entry = F.concat(F.lit("\n## Meeting of "), day.cast("string"), F.lit(" #"), F.col("turn").cast("string"), F.lit("\n"), F.translate("text", "#\n", "  "))
    each = c.select("conv_id", entry.alias("log")).select("conv_id", F.explode(F.slice(F.split("log", "\n## Meeting of "), 2, 1 << 30)).alias("e"))
    dated = each.select("conv_id", F.to_date(F.regexp_extract("e", r"^(\d{4}-\d{2}-\d{2})", 1)).alias("day"), F.regexp_extract("e", r"#(\d+)\n", 1).cast("long").alias("turn"))
    g = dated.groupBy("conv_id").agg(F.max(F.struct("day", "turn")).alias("x"), F.count("*").alias("entries"))
    return g.select("conv_id", "x.turn", F.col("x.day").cast("string").alias("day"), "entries")
