"""What kind of document a file is: ordered rules over its name, its folder, its opening and its text, of which the first wins.

A rule is (kind, what must hold, what must not); what it says of a field is a pattern.  Where a rule has rules in place of a
kind, they settle what it fits.  Lists of rules become one nested CASE, in Spark and in SQL, over fields that are made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import markdown
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

UNKNOWN = "unknown"
#: What a list of rules says where it has no answer on purpose and the next list goes on.
PASS = ""
#: How much of a text is its opening, its heading, its caption and its filing, in characters.
OPENING, HEADING, CAPTION, FILING = 1600, 350, 1500, 4000
#: The line under which a bill is brought in, and how a text begins that amends.
BILL_LINE = r"(?m)^[ \t]*(?:(?:a |an )?(?:sga )?(?:event )?(?:funding )?(?:bill|act)\b|amendment of)[^\n]*"
AMENDING = r"(?im)^(?:a\s+)?(?:bill|act)\s+to\s+amend\b[^.\n]{0,100}"
COMMITTEE_TERM = r"(?i)minutes|\bmins\b|meetings?|notes|agendas?|fall|spring|summer|winter|(?:19|20)\d{2}"

# Fixed values from here to the end of the rules: kinds and the patterns by which names, folders and openings tell them.
# Fields: name is the file's name with its marks as spaces, folder likewise; placed is the name and the folder, headed the
# name and the heading; titled is the name and the title shown, path the folder as it is, filed path and titled.
_BODIES = lambda field: (
    ("minutes.executive", [(field, "exec")], []),
    ("minutes.judicial", [(field, "judicial|judiciary")], []),
    ("minutes.committee", [(field, "committee|commitee")], []),
    ("minutes.senate", [(field, r"senate|general sga|general body|\bgbm\b")], []),
)
_AMENDED = (("bill.bylaws_amendment", [("titled", "bylaw")], []), ("bill.constitution_amendment", [], []))
BILLS = (
    ("bill.senate_rules", [("billed", "procedural rules|senate rules|standing rules|rules bill")], []),
    ("bill.bylaws_constitution_amendment", [("bill", "bylaws?"), ("bill", "amend"), ("bill_opening", "(?s)^[^\n]*constitution|\n.*constitutional amendments? proposed in this bill")], []),
    ("bill.bylaws_amendment", [("bill", "bylaws?"), ("bill", "amend")], []),
    ("bill.constitution_amendment", [("bill", "constitution"), ("bill", "amend")], []),
    ("bill.senate_rules", [("opening", "procedural rules|senate rules|standing rules")], []),
    ("bill.funding", [("name", "funding|appropriation|budget")], []),
    ("bill.funding", [("bill", "funding bill|bill.{0,80}(?:fund|allocat|appropriat)|act to fund")], []),
    ("bill.other", [], []),
)
MEETINGS = (
    ("notes.meeting", [("name", "faculty senate|exec director")], []),
    ("minutes.executive", [("name", r"\bexec")], []),
    ("minutes.senate", [("name", r"senate|general body|\bgbm\b")], [("name", r"\bcso\b")]),
    ("minutes.class_council", [("placed", r"class council|class of 20\d\d|\bsocc\b|sophomoreclasscouncil|sophmore")], []),
    ("minutes.committee", [("placed", r"\bcmc\b|communications.{0,8}marketing|programming committee")], []),
    ("minutes.committee", [("placed", "committee|student org|academic affairs|health.{0,12}safety|sustainability|student services|civic engagement")], [("folder", "demarri")]),
    ("minutes.executive", [("placed", r"\bexec")], []),
    ("minutes.senate", [("placed", r"senate|general body|\bgbm\b")], []),
    ("minutes.other", [], []),
)
RECORDS = (
    (PASS, [("placed", "judicia")], []),
    ("working.document", [("name", r"\bpersonal rewrite\b")], []),
    ("media", [("mime", "^image/")], []),
    ("media", [("file", r"\.(?:png|jpe?g|heic|gif|webp)\b")], []),
    ("media", [("name", r"\b(?:portraits|pictures|photos)\b")], []),
    ("template", [("name", r"\btemplate\b|minutes framework")], []),
    ("template", [("folder", r"/(?:templates|templates and examples|templates\s+examples)$")], []),
    ("resume", [("name", r"\bresume\d*\b|\bcv\b")], []),
    ("resume", [("folder", "/resume(?:s|~1)?$")], []),
    ("reference", [("folder", r"/(?:research|international research|philosophical research|university document compendium|\d+ reference materials)(?:/[^/]+)?$")], []),
    (PASS, [("name", r"\bresolution\b")], []),
    (BILLS, [("name", r"\bsga b \d|\bs b\.\d")], [("name", r"minutes|agenda|meeting|\bideas\b")]),
    (BILLS, [("opening", r"\b(?:s\.?\s*bill|s[. -]b[. -]\d|sga[. -]b[. -]\d|(?:a|an)\s+(?:sga\s+)?(?:event\s+)?(?:funding\s+)?bill)\b"), ("bill", ".")], [("name", r"minutes|agenda|meeting|\bideas\b")]),
    (PASS, [("name", r"\bbill\b|\bact\b|bylaws?|constitution")], [("name", "training|personal rewrite|highlights")]),
    ("attendance", [("name", "attendance")], [("name", "guideline")]),
    ("directory", [("name", "email list|contact list|contact sheet|directory")], []),
    ("tracker", [("name", "tracker")], []),
    ("schedule", [("name", r"sign\s?up|scheduling")], []),
    ("finance.record", [("name", r"\b(?:invoice|receipt|quote\d*|purchase order|financial statement)\b")], []),
    ("finance.record", [("name", r"\b(?:budget|funding request|request for funding|request.*funds|fund request)\b")], [("name", r"\bbill\b|\bact\b|resolution|amendment")]),
    ("transition", [("name", r"\b(?:transition|handover)\b")], []),
    ("transition", [("folder", r"/(?:transition documents|transition to \d+.*|executive board transition documents)(?:/[^/]+)?$")], []),
    ("survey", [("name", r"\b(?:survey|questionnaire|feedback|responses)\b")], [("name", "report|analysis")]),
    ("application", [("name", r"\b(?:application|applications|evaluations?|registration submissions|re registration)\b")], []),
    ("application", [("folder", "student group applications|new group registration")], []),
    ("report", [("name", r"\b(?:report|findings|investigation summary|activity summary|summary of.*activities)\b")], [("name", "post meeting report")]),
    ("correspondence", [("name", r"\b(?:letter|email|memorandum|memos?|groupme message|solicitation)\b")], []),
    ("correspondence", [("folder", "all school emails|monthly emails|confirmation emails")], []),
    ("correspondence", [("heading", r"^\s*(?:from:|dear\b)")], []),
    ("statement", [("name", r"\b(?:statement|press release|op ed)\b")], [("name", "mission statement|financial statement")]),
    ("schedule", [("name", r"\b(?:calendar|schedule|timeline|itinerary|sign\s?ups?|timeslot|volunteering)\b")], []),
    ("petition", [("name", r"\b(?:petition|referendum questions)\b")], []),
    ("reference", [("name", r"\b(?:handbook|handout|manual|guide|instructions|how to|faq|cheat sheet|flowchart|codebook|user guide|guidelines?|oaths? of office|duties|responsibilities|role description|tips for|polic(?:y|ies)|procedures|mission statement)\b")], []),
    ("directory", [("name", r"\b(?:links|address book|master list|list of (?:clubs|.*organizations|.*members)|members of|committee placements|committee memberships)\b")], []),
    ("tracker", [("name", r"\b(?:task|to do|milestones|assignments|disciplinary marks|tracksheet|tracking|aggregate legislation data)\b")], []),
    ("plan", [("name", r"\b(?:plan|planning|proposal|initiative|initiatives|ideas|aspirations|goals|objectives)\b")], []),
    ("notes.meeting", [("name", r"\bquestions?\b|discussion (?:points|topics)")], []),
    ("notes.meeting", [("name", r"meeting (?:with|w/|witih)|call notes|phone call|coordination call|debrief")], []),
    ("notes.meeting", [("folder", "miscellaneous meetings|administrator meetings")], []),
    (MEETINGS, [("headed", r"minutes|mintues|\bagenda|\bmeeting|post meeting report|\bmtg\b|executive #\d")], []),
    (MEETINGS, [("folder", r"/(?:agendas?\s*(?:and\s*)?minutes|(?:freshmen meeting |exec meeting |exec )?minutes|exec meetings|first semester|second semester)$"), ("name", r"^\d")], []),
    ("working.document", [("name", r"\b(?:working doc|drafting doc|running doc|writeup|write up|notes|website changes|website update)\b")], []),
    ("event.material", [("name", r"\b(?:trivia|flyer|decor|scavenger hunt|food order|food and drink|icebreaker|workshop|training|teambuilding|event|formal|garden party|soph show|retreat|tabling|senior week|senior day)\b")], []),
    ("election", [("name", r"\belections?\b")], []),
)
SHOWN = (
    [("mime", "(?i)presentation")], [("titled", r"\b(?:presentation|slides|deck|briefing)\b")], [("titled", r"\b(?:committee|council|caucus) updates?\b")], [("titled", r"\bupdates?\b"), ("path", "agenda")],
)
JUDICIAL = (
    (PASS, [("titled", "minutes|agenda")], []),
    ("judicial.advisory_opinion", [("pleaded", "advisory opinion")], []),
    ("judicial.opinion", [("titled", "opinion|decision")], []),
    ("judicial.opinion", [("filed", r"\bopinions?\b")], []),
    ("judicial.writ_of_certiorari", [("pleaded", r"writ of certiorari|\bcertiorari\b")], []),
    ("judicial.writ_of_mandamus", [("pleaded", r"writ of mandamus|\bmandamus\b")], []),
    (PASS, [], [("filed", "judicial|judiciary"), ("titled", r"\bwrit\b")]),
    ("judicial.order", [("titled", r"\border\b")], []),
    ("judicial.complaint", [("titled", "complaint|petition")], []),
    ("judicial.writ", [("titled", r"\bwrit\b")], []),
    ("judicial.other", [("filed", "judicial|judiciary")], []),
)
_CHANGES = [("titled", r"amendment|amend\b|resolution")]
_HELD = (*_BODIES("titled"), *_BODIES("filed"), (UNKNOWN, [], []))
FILES = (
    ("attendance", [("filed", "attendance")], []),
    ("directory", [("filed", "roster|email list|contact list|contact sheet|directory")], []),
    ("working.document", [("titled", r"\bpersonal rewrite\b")], []),
    ("template", [("titled", r"\btemplate\b")], []),
    ("tracker", [("titled", "vot(?:ing|e) records?|tracksheet|initiative tracker|bill tracker")], []),
    ("bill.bylaws_constitution_amendment", [("amends", "(?i)bylaws?"), ("amends_body", "(?i)^[^\n]*constitution|constitutional amendments? proposed in this bill")], []),
    ("bill.bylaws_amendment", [("amends", "(?i)bylaws?")], []),
    ("bill.constitution_amendment", [("amends_body", "(?i)^[^\n]*constitution|constitutional amendments? proposed in this bill")], []),
    ("bill.bylaws_constitution_amendment", [("titled", "bylaw"), ("titled", "constitution"), *_CHANGES], []),
    (_AMENDED, [("titled", "bylaw|constitution"), *_CHANGES], []),
    *(("presentation", must, []) for must in SHOWN),
    ("resolution", [("titled", r"\bresolutions?\b")], []),
    ("resolution", [("caption", r"(?im)^(?:[\s{]*S\.?\s+Resolution\b|A Resolution\b)")], [("titled", r"\bbill\b|\bact\b")]),
    ("guiding.bylaws", [("titled", "bylaw")], [("titled", "constitution")]),
    ("guiding.constitution", [("titled", "constitution")], []),
    ("bill.constitution_amendment", [("path", "constitution"), *_CHANGES], [("titled", "bylaw")]),
    ("guiding.constitution", [("path", "constitution")], [("titled", "bylaw")]),
    ("bill.bylaws_amendment", [("filed", "bylaw"), *_CHANGES], []),
    ("guiding.bylaws", [("filed", "bylaw")], []),
    (JUDICIAL, [], []),
    ("bill.senate_rules", [("filed", r"senate rules|standing rules|\brules bill\b")], []),
    ("bill.funding", [("filed", "funding|budget|appropriation")], []),
    ("bill.other", [("titled", r"\bbill\b|\bact\b|\bresolution\b")], [("titled", "template")]),
    ("tracker", [("filed", "tracksheet|initiative tracker")], []),
    (_HELD, [("titled", r"minutes|agenda|\bmins\b|\bgbm\b|general body")], []),
    (_HELD, [("titled", "meeting"), ("titled", _BODY := r"exec|judicial|judiciary|committee|commitee|senate|general sga|general body|\bgbm\b")], []),
    (_HELD, [("titled", "meeting"), ("own_records", "yes")], []),
    (_HELD, [("titled", "meeting"), ("filed", _BODY)], [("path", r"(?:^|/)(?:\d+_)?committees/")]),
    ("guiding.other", [("path", "guiding document")], []),
)
RULES = (*(("presentation", must, [("titled", r"\btemplate\b")]) for must in SHOWN), (RECORDS, [], []), (FILES, [], []))


def _settles(rules) -> bool:
    """Whether a list of rules always has an answer: its last rule asks for nothing."""
    kind, must, never = rules[-1]
    return not must and not never and (isinstance(kind, str) or _settles(kind))


def first_fit(rules, fields) -> Column:
    """The kind by the first rule that fits; null where none does or the list passes."""
    pending, out = [], None
    for kind, must, never in rules:
        fits = F.lit(True)
        for field, pattern in must:
            fits = fits & fields(field).rlike(pattern)
        for field, pattern in never:
            fits = fits & ~fields(field).rlike(pattern)
        if isinstance(kind, str):
            value = F.lit(kind if kind else None).cast("string")
        else:
            value = first_fit(kind, fields)
            if not _settles(kind):  # what it leaves open goes on below the rules so far
                pending.append((out, F.when(fits, value)))
                out = None
                continue
        out = F.when(fits, value) if out is None else out.when(fits, value)
    for before, value in reversed(pending):
        rest = value if out is None else F.coalesce(value, out)
        out = rest if before is None else before.otherwise(rest)
    return out


def first_fit_sql(rules) -> str:
    """The same as DuckDB SQL over columns named as the fields."""
    whens, tail = [], "null"
    for k, (kind, must, never) in enumerate(rules):
        parts = [markdown.matches_sql(f, p) for f, p in must] + [f"not {markdown.matches_sql(f, p)}" for f, p in never]
        if not isinstance(kind, str) and not _settles(kind):
            rest = rules[k + 1 :]
            tail = f"coalesce(case when {' and '.join(parts) or 'true'} then {first_fit_sql(kind)} end, {first_fit_sql(rest) if rest else 'null'})"
            break
        value = (markdown.quoted(kind) if kind else "null") if isinstance(kind, str) else first_fit_sql(kind)
        whens.append(f"when {' and '.join(parts) or 'true'} then {value}")
    return f"(case {' '.join(whens)} else {tail} end)" if whens else tail


def with_fields(files: DataFrame) -> DataFrame:
    """``files`` (name, folder_path, content, shown, mime; nulls as empty) with the fields that rules read, whole texts as prose once."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    spaced = lambda c: F.translate(F.lower(text(c)), "_-", "  ")
    d = files.withColumns({"name_": spaced("name"), "folder": spaced("folder_path"), "file": F.lower(text("name")), "path": F.lower(text("folder_path")), "mime": text("mime"), "body": markdown.prose_lines(text("content")), "filing": F.lower(F.substring(text("content"), 1, FILING))})
    titled = F.trim(F.regexp_replace(F.translate(F.lower(F.concat_ws(" ", text("name"), text("shown"))), "_", " "), r"\s+", " "))
    d = d.withColumns({"titled": titled, "opening": F.lower(F.substring("body", 1, OPENING)), "caption": F.substring("body", 1, CAPTION)})
    d = d.withColumns({"filed": F.concat_ws("/", "path", "titled"), "heading": F.substring("opening", 1, HEADING), "bill": F.regexp_extract("opening", BILL_LINE, 0), "amends": F.regexp_extract("caption", AMENDING, 0), "placed": F.concat_ws(" ", "name_", "folder")})
    below = F.regexp_extract("path", r"(?:^|/)(?:\d+_)?committees/[^/]+((?:/[^/]*)*)$", 1)
    own = F.col("path").rlike(r"(?:^|/)(?:\d+_)?committees/[^/]") & F.forall(F.filter(F.split(below, "/"), lambda x: x != ""), lambda x: x.rlike(COMMITTEE_TERM))
    return d.withColumns({
        "headed": F.concat_ws("\n", "name_", "heading"), "billed": F.concat_ws(" ", "bill", "name_"), "bill_opening": F.concat_ws("\n", "bill", "opening"), "amends_body": F.concat_ws("\n", F.translate("amends", "\n", " "), "body"),
        "pleaded": F.when(F.col("filed").rlike("judicial|judiciary"), F.concat_ws("\n", "titled", "filing")).otherwise(F.col("titled")), "own_records": F.when(own, "yes").otherwise("no"),
    })


def classified(files: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """``files`` (id, name, folder_path, content, shown, mime) as (id, kind); what was reviewed (id, kind) is as it was reviewed.

    One scan without a shuffle; only the reviewed ids are joined.  Null fields count as empty, ids may repeat or be null, and a
    file of which nothing is known is "unknown".
    """
    kind = F.coalesce(first_fit(RULES, lambda f: F.col("name_" if f == "name" else f)), F.lit(UNKNOWN))
    out = with_fields(files.select("id", "name", "folder_path", "content", "shown", "mime")).select("id", kind.alias("kind"))
    if reviewed is None:
        return out
    said = reviewed.groupBy("id").agg(F.min("kind").alias("said"))
    return out.join(said, "id", "left").select("id", F.coalesce("said", "kind").alias("kind"))


# --- queries -------------------------------------------------------------------------------------------------------------

#: Names that files of an archive bear, a cycle over the titles of the table.
NAMES = (
    "Senate GBM #15", "S.B. 4 Funding Bill", "Bylaws 2024", "Constitution Amendment", "SGA Bill Template", "Attendance Sheet", "Budget overview", "Senator Contact List", "Writ of Certiorari", "Opinion in re Elections", "Spring Retreat plan", "Committee Updates",
    "The Accountability Act", "Resolution on Dining", "Handover notes", "IMG_2.jpg", "Bill Voting Records", "Meeting with Dean", "Exec Minutes 4/1", "Fall Meeting", "Standing rules", "Survey responses", "Elections FAQ", "untitled",
)
FOLDERS = ("Archive/112", "03_Committees/Internal Affairs/Fall 2026", "Judiciary/Filings", "Guiding documents", "03_Committees/Internal Affairs/Ann", "Agendas", "x/Templates")
OPENINGS = ("", "## Call to Order\n", "A Bill to Amend the Bylaws of the body\n", "Dear all,\n", "A Resolution\n", "An SGA Bill\nto fund the **festival**\n", "advisory opinion\n", "Act to amend the Constitution and the bylaws\n")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files with a name, a folder and an opening."""
    k = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(k / n), F.lit(len(values))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(k.alias("id"), pick(NAMES, 1).alias("name"), pick(FOLDERS, 5).alias("folder_path"), F.concat(pick(OPENINGS, 3), F.coalesce("text", F.lit(""))).alias("content"), F.lit("").alias("shown"), F.lit("").alias("mime"))


_pick = lambda values, n: f"([{', '.join(map(markdown.quoted, values))}])[((doc_id // {n}) % {len(values)} + 1)::int]"
_FILES_SQL = f"f as (select doc_id as id, {_pick(NAMES, 1)} as title, {_pick(FOLDERS, 5)} as folder_path, {_pick(OPENINGS, 3)} || coalesce(text, '') as content from documents)"
_FIELDS_SQL = f"""{_FILES_SQL}, a as (select id, translate(lower(title), '_-', '  ') as name, translate(lower(folder_path), '_-', '  ') as folder, lower(title) as file, lower(folder_path) as path, '' as mime,
 array_to_string(list_transform(string_split(content, chr(10)), lambda x: {markdown.prose_sql('x')}), chr(10)) as body, lower(left(content, {FILING})) as filing, trim(regexp_replace(translate(lower(title), '_', ' '), '\\s+', ' ', 'g')) as titled from f),
b as (select *, lower(left(body, {OPENING})) as opening, left(body, {CAPTION}) as caption, path || '/' || titled as filed, name || ' ' || folder as placed from a),
c as (select *, left(opening, {HEADING}) as heading, regexp_extract(opening, {markdown.quoted(BILL_LINE)}) as bill, regexp_extract(caption, {markdown.quoted(AMENDING)}) as amends from b),
e as (select *, name || chr(10) || heading as headed, bill || ' ' || name as billed, bill || chr(10) || opening as bill_opening, translate(amends, chr(10), ' ') || chr(10) || body as amends_body,
 case when regexp_matches(filed, 'judicial|judiciary') then titled || chr(10) || filing else titled end as pleaded,
 case when regexp_matches(path, '(?:^|/)(?:\\d+_)?committees/[^/]') and len(list_filter(string_split(regexp_extract(path, '(?:^|/)(?:\\d+_)?committees/[^/]+((?:/[^/]*)*)$', 1), '/'), lambda x: x <> '' and not regexp_matches(x, {markdown.quoted(COMMITTEE_TERM)}))) = 0 then 'yes' else 'no' end as own_records from c)"""


@REGISTRY(f"with {_FIELDS_SQL} select id, coalesce({first_fit_sql(RULES)}, '{UNKNOWN}') as kind from e")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every file."""
    return classified(files(spark, sf_dir))


@REGISTRY(f"""with {_FIELDS_SQL}, n as (select id, coalesce({first_fit_sql(RULES)}, '{UNKNOWN}') as now, case when id % 3 = 0 then 'unknown' when id % 7 = 0 then 'report' end as was from e)
select coalesce(was, now) as was, now, count(*)::bigint as files, count(*) filter (was <> now)::bigint as moved from n group by all""")
def kinds_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules as they are now do to files that were classified before: how many move, from each kind to each."""
    was = F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 7 == 0, "report")
    n = classified(files(spark, sf_dir)).select(F.coalesce(was, "kind").alias("was"), F.col("kind").alias("now"))
    return n.groupBy("was", "now").agg(F.count("*").alias("files"), F.count_if(F.col("was") != F.col("now")).alias("moved"))


_READ = f"list_transform(regexp_split_to_array({markdown.replaced_sql('content', markdown.LEFTOVERS)}, '\\n\\s*\\n'), lambda b: struct_pack(head := starts_with(regexp_replace(b, '\\A\\s+', ''), '#'), line := {markdown.prose_sql('b')}))"
_HEAD = f"left(line, {markdown.LIMIT - 3})"
_AT = f"(length({_HEAD}) - strpos(reverse({_HEAD}), ' '))"


@REGISTRY(f"""with {_FILES_SQL}, r as (select id, {_READ} as r from f), u as (select id, list_filter(r, lambda x: not {markdown.noise_sql('x.line')}) as u from r),
l as (select id, coalesce(list_filter(u, lambda x: not x.head)[1].line, u[1].line, '') as line from u)
select id, case when length(line) <= {markdown.LIMIT} then line else regexp_replace(case when strpos({_HEAD}, ' ') > 0 and {_AT} > {markdown.LIMIT * 0.6} then left({_HEAD}, {_AT}) else {_HEAD} end, '\\s+\\z', '') || '...' end as description from l""")
def document_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that describes each file in a listing."""
    return files(spark, sf_dir).select("id", markdown.description(F.col("content")).alias("description"))
