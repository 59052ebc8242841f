"""Secret scanning over a content-addressed ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text.  A blob is scanned once for each (rule, version)
that the ledger doesn't hold yet, and its findings are joined back to all paths and versions that have that content.
The ledger only grows: an increment appends the entries of unseen pairs, and blobs that no table has any more stay in it,
so that they aren't scanned anew when they come back.  All of it is DataFrame operations: matches and the gaps between them come from the same regular expression, so that
positions are running sums of lengths in code points.

Defined cases: a null text is empty; a null path or id is carried through; repeated rows return a row each; an empty
table gives an empty ledger and no rows; a text may be of any length, as positions are summed over rows and not inside
one value; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: the group whose length counts
    least: int = 1  #: characters it must have
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
BASE = ("assign", "access", "hex")

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _parts(rule: Rule, text: Column) -> Column:
    """Lengths of the gaps before each match, of the matches, and of the group that counts."""
    p = F.lit(rule.pattern)
    # a run of hexadecimal digits that is too short can't hide another: match the long ones only
    if rule.kind == "hex":
        p = F.lit(rf"[0-9a-f]{{{rule.least},}}")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    size = lambda x: F.transform(x, F.length)
    counted = size(F.regexp_extract_all(text, p, F.lit(rule.group))) if rule.group else size(whole)
    return F.when(F.size(whole) > 0, F.arrays_zip(size(F.split(text, rule.pattern if rule.kind != "hex" else rf"[0-9a-f]{{{rule.least},}}", -1)).alias("gap"), size(whole).alias("len"), counted.alias("counted")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) for every blob of ``blobs`` (blob, text, todo: array of rule keys); found lists what those rules match."""
    parts = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), F.when(F.array_contains("todo", r.key), _parts(r, F.col("text"))).alias("parts")) for r in rules])
    each = blobs.select("blob", F.explode(parts).alias("r")).select("blob", "r.kind", "r.rule", "r.least", F.posexplode_outer("r.parts").alias("k", "part"))
    by_position = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("part.gap") + F.coalesce("part.len", F.lit(0))).over(by_position)
    placed = each.withColumn("end", run.cast("long"))
    hit = F.col("part.len").isNotNull() & (F.col("part.counted") >= F.col("least"))
    return placed.groupBy("blob").agg(F.collect_list(F.when(hit, F.struct("rule", "kind", (F.col("end") - F.col("part.len")).alias("start"), "end"))).alias("found"))


ENTRIES = "blob binary, rules array<string>, found array<struct<rule:string,kind:string,start:bigint,end:bigint>>"


def new_entries(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(blob, rules, found) for the blobs of ``versions`` that ``ledger`` lacks under some current rule version.

    Only the missing (blob, rule version) pairs are scanned.  These rows are what an increment appends to the ledger.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    # copies meet as one row a task: the aggregate combines before the shuffle
    blobs = versions.select(content_address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return scan(blobs.withColumn("todo", keys), rules).select("blob", keys.alias("rules"), "found")
    held = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("held"))
    todo = blobs.join(held, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("held", F.expr("cast(array() as array<string>)"))))
    return scan(todo.where(F.size("todo") > 0).select("blob", "text", "todo"), rules).select("blob", keys.alias("rules"), "found")


def merged(entries: DataFrame) -> DataFrame:
    """One row a blob of a ledger whose increments were appended; all of its rule versions and findings."""
    return entries.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.flatten(F.collect_list("found")).alias("found"))


def ledger_of(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger after ``versions``: every entry that ``ledger`` holds, of blobs that are gone too, and the new ones."""
    fresh = new_entries(versions, ledger, rules, text)
    return fresh if ledger is None else merged(ledger.select("blob", "rules", "found").unionByName(fresh))


def scanned_in_parts(versions: DataFrame, parts: int = 2, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The written ledger of ``versions``, fed in ``parts`` increments: each is appended, reread, and spares the next its blobs."""
    spark = versions.sparkSession
    path, ledger = C.scratch_dir(spark), None
    for k in range(parts):
        part = versions.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k)
        new_entries(part, ledger, rules, text).write.mode("append").parquet(path)
        ledger = spark.read.schema(ENTRIES).parquet(path)
    return ledger


def content_address(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """``versions`` with ``name``: array of (kind, start, end) by start, then kind as listed; empty where there are none.

    Blobs that ``ledger`` lacks are scanned.  The entries with findings are written and read again, so that both sides of
    the join back are plain exchanges by blob, which adaptive execution splits where a blob has very many versions.
    """
    return joined_back(versions, ledger_of(versions, ledger, rules, text), rules, text, name)


def joined_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """``versions`` with the spans that the complete ledger holds for them under ``rules``."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array(*[F.lit(r.key) for r in rules])
    ordered = F.array_sort(F.transform("found", lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("place"), f["end"].alias("end"), f["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    some = ledger.withColumn("found", F.filter("found", lambda f: F.array_contains(current, f["rule"]))).where(F.size("found") > 0)
    hits = C.written(merged(some).select(F.col("blob").alias("_parchment_blob"), spans.alias("_parchment_spans")))
    addressed = versions.withColumn("_parchment_blob", content_address(text))
    return addressed.join(hits, "_parchment_blob", "left").withColumn(name, F.coalesce("_parchment_spans", F.expr(f"cast(array() as {SPAN})"))).drop("_parchment_blob", "_parchment_spans")


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``findings``' rows."""
    count = lambda kind: F.size(F.filter("spans", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda f: f["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redacted(versions: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``versions`` with every found span of ``text`` replaced by ``mark``; rows without findings are unchanged.

    Overlapping spans are merged first.  The text is rebuilt from the pieces between spans.
    """
    cols = versions.columns
    joined = F.aggregate(
        "_parchment_found", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, f: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= f["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], f["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(f["start"].alias("start"), f["end"].alias("end"))))))
    found = findings(versions, text=text, name="_parchment_found").withColumn("_parchment_cut", joined)
    cut = F.transform(F.sequence(F.lit(0), F.size("_parchment_cut")), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get("_parchment_cut", i - 1)["end"]).alias("a"),
        F.when(i == F.size("_parchment_cut"), F.length(text)).otherwise(F.get("_parchment_cut", i)["start"]).alias("b")))
    pieces = F.transform(cut, lambda c: F.substring(F.col(text), (c["a"] + 1).cast("int"), (c["b"] - c["a"]).cast("int")))
    return found.withColumn(text, F.when(F.size("_parchment_cut") > 0, F.array_join(pieces, mark)).otherwise(F.col(text))).select(*cols)
