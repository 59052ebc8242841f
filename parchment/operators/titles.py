"""Titles as they are shown: filenames tidied word by word, meetings named alike, and no name that two documents would share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import records
from parchment.plans.registry import Registry
from parchment.sources.scratch import cut

REGISTRY = Registry()

# Strings that are written as here, words that stay small inside a title, committees as they are written, and
# what meetings and their two sides are called.
ACRONYMS = "SGA JHU GBM RSO KSAS WSE CE IA SS AA HSS CSO PC FC SBP CSC BSC MSE TBD AV SHWB Q&A II III IV CSAC JHUMA SARU ABSA MELA PRDC".split()
SMALL = "a an and as at but by for in of on or the to with vs v".split()
COMMITTEES = {"health safety and sustainability": "Health, Safety and Sustainability"}
MEETINGS = {"senate": "Senate General Body Meeting", "executive": "Executive Board Meeting", "executive:summer": "Summer Executive Board Meeting", "judicial": "Judiciary Meeting"}
SIDES = {"agenda": "Agenda", "minutes": "Minutes"}


def _known(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


_WRITTEN = {a.lower(): a for a in ACRONYMS}


def capitalised(word: Column, first: Column) -> Column:
    """A word in a title: acronyms as they are written, small words small unless they open it, others with their first letter large."""
    bare = F.lower(F.regexp_replace(word, "[^A-Za-z&]", ""))
    low = F.lower(word)
    lead = F.regexp_extract(low, "^[^a-z]*", 0)
    large = F.concat(lead, F.upper(F.substring(low, F.length(lead) + 1, F.lit(1))), F.substring(low, F.length(lead) + 2, F.length(low)))
    before = F.regexp_extract(word, "^[^A-Za-z&]*", 0)
    after = F.regexp_extract(word, "^[^A-Za-z&]*[A-Za-z&]+(.*)$", 1)
    acronym = _known(_WRITTEN, bare)
    return F.when(acronym.isNotNull(), F.concat(before, acronym, after)).when(~first & bare.isin(*SMALL), low).otherwise(large)


def is_shouting(word: Column) -> Column:
    """Whether a run of letters in it is all large and is no acronym: a small word, or four letters and more."""
    return F.exists(F.regexp_extract_all(word, F.lit("[A-Za-z]+"), F.lit(0)), lambda r: (r == F.upper(r)) & ~F.lower(r).isin(*_WRITTEN) & (F.lower(r).isin(*SMALL) | (F.length(r) >= 4)))


def clean_title(raw: Column) -> Column:
    """A filename without its ending and its underscores; words that shout are set small, all else is left as it is."""
    bare = F.regexp_replace(raw, r"(?i)\.(docx?|pdf|txt|md)$", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.translate(bare, "_", " "), r"\s+", " "), r"\s+([,.;:])", "$1"))
    words = F.transform(F.split(flat, " "), lambda w, k: F.when(is_shouting(w), capitalised(w, k == 0)).otherwise(w))
    return F.array_join(words, " ")


def title_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w, k: capitalised(w, k == 0)), " ")


def body_label(body: Column) -> Column:
    """What a meeting of a body is called; null for bodies without a name."""
    name = F.regexp_replace(body, "^(committee|caucus):", "")
    committee = F.concat(F.coalesce(_known(COMMITTEES, name), title_case(name)), F.lit(" Committee Meeting"))
    caucus = F.concat(title_case(name), F.when(name.rlike(r"(?i)\bcaucus$"), "").otherwise(" Caucus"), F.lit(" Meeting"))
    return F.when(body.startswith("committee:"), committee).when(body.startswith("caucus:"), caucus).otherwise(_known(MEETINGS, body))


def meeting_dates(sides: DataFrame) -> DataFrame:
    """(key, met): the day of each meeting from its documents (key, role, stated, created).

    What the minutes state, else the agenda, else the day on which the minutes were made, else any of its documents; a day
    on which documents of several meetings of one body were made says nothing.  Two aggregates; no document meets another.
    """
    body = F.regexp_extract("key", "^(.*):[^:]*$", 1)
    s = sides.where("key <> ''").withColumn("body", body).withColumn("day", F.to_date("created"))
    sole = s.where("day is not null").groupBy("body", "day").agg((F.min("key") == F.max("key")).alias("sole"))
    s = s.join(sole, ["body", "day"], "left")
    made, minutes = F.when(F.col("sole"), F.col("day")), F.col("role") == "minutes"
    g = s.groupBy("key").agg(F.min(F.when(minutes, F.col("stated"))).alias("a"), F.min(F.when(F.col("role") == "agenda", F.col("stated"))).alias("b"), F.min(F.when(minutes, made)).alias("c"), F.min(made).alias("d"))
    return g.select("key", F.coalesce("a", "b", "c", "d").alias("met"))


def meeting_title(key: Column, role: Column, met: Column) -> Column:
    """``Senate General Body Meeting #4 — Minutes (09/06/26)``; null where the key's body has no name."""
    body, ordinal = F.regexp_extract(key, "^[^:]*:(.*):[^:]*$", 1), F.regexp_extract(key, "^[^:]*:.*:([^:]*)$", 1)
    dated = ordinal.rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = F.when(dated, F.concat(F.substring(ordinal, 6, 2), F.lit("/"), F.substring(ordinal, 9, 2), F.lit("/"), F.substring(ordinal, 3, 2))).otherwise(F.date_format(met, "MM/dd/yy"))
    number = F.when(dated, "").otherwise(F.concat(F.lit(" #"), ordinal))
    return F.when((ordinal != "") & (body != ""), F.concat(body_label(body), number, F.lit(" — "), _known(SIDES, role), F.coalesce(F.concat(F.lit(" ("), day, F.lit(")")), F.lit(""))))


def shown_titles(named: DataFrame) -> DataFrame:
    """(id, shown) of documents (id, title, canonical, secondary): the canonical name where one document alone has it and no
    other's tidied filename is the same, else the tidied filename; headlines of the press are shown as they were set.

    Two aggregates by name settle the whole corpus, with a row a name however many documents share it.
    """
    clean = F.when(F.col("secondary"), F.col("title")).otherwise(F.coalesce(F.when(clean_title(F.col("title")) != "", clean_title(F.col("title"))), F.col("title")))
    d = cut(named).select("id", clean.alias("clean"), F.when(~F.coalesce("secondary", F.lit(False)), F.col("canonical")).alias("canonical"))
    d = cut(d)  # names are made once and not in every join
    alone = d.where("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    taken = d.groupBy(F.col("clean").alias("canonical")).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    won = alone.join(taken, "canonical", "left").where("least is null or (least = id and most = id)").select("id", F.col("canonical").alias("won"))
    return d.join(won, "id", "left").select("id", F.coalesce("won", "clean").alias("shown"))


@REGISTRY()
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title under which each file of the archive of meetings is shown."""
    t = records.titles(spark, sf_dir)
    m = cut(records.meetings(t).select("id", "key", "role", "created", F.lit(None).cast("date").alias("stated")))
    named = m.join(meeting_dates(m), "key").select("id", meeting_title(F.col("key"), F.col("role"), F.col("met")).alias("canonical"))
    return shown_titles(t.join(named, "id", "left").select("id", "title", "canonical", F.lit(False).alias("secondary")))
