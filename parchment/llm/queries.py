"""The queries of this subpackage and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, html_wrappers, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, token_alignment, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_words(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_bytes(suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(token_store.write_store(_table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("posterior"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.joined_back(docs, secret_scan.scanned_in_parts(docs)))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_table(spark, sf_dir, "documents"))


def op11_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(_table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_store": op8_token_store,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_html_wrappers": op11_html_wrappers,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _spans_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, {place} as place, '{kind}' as kind, m, k, list_sum(list_transform(s[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) as a
from (select doc_id, m, s, unnest(range(1, len(m) + 1)) as k, g
      from (select doc_id, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as g, regexp_split_to_array(t, '{p}') as s from texts))
where length(g[k]) >= {least}"""


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SPANS = " union all ".join((
    _spans_sql(0, "assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    _spans_sql(1, "access", "AKIA[A-Z0-9]+", 0, 18),
    _spans_sql(2, "hex", "[0-9a-f]+", 0, 16),
    _spans_sql(3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    _spans_sql(4, "forge", "gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
))

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": rf"""
with words as (select doc_id, {WORDS} as ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from words where len(ws) >= 20),
ranked as (select doc_id, i, row_number() over (partition by array_to_string(ws[i : i + 19], ' ') order by doc_id, i) as k from starts),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from ranked where k > 1),
each_word as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from words),
kept as (select e.doc_id, string_agg(e.w, ' ' order by e.p) as t, count(*) as n
         from each_word e anti join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words w left join kept k on w.doc_id = k.doc_id""",
    "op3_suffix_dedup": """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, h, unnest(range(0, len(h) // 2 - 399)) as i from bytes where len(h) >= 800),
digests as (select doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) as d from starts),
again as (select d from digests group by d having count(*) > 1),
edges as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from digests semi join again using (d)),
heads as (select doc_id, i, sum(case when before is null or i > before + 400 then 1 else 0 end) over (partition by doc_id order by i) as span from edges),
spans as (select doc_id, span, min(i) as a, max(i) + 400 as b from heads group by doc_id, span),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from spans),
parts as (select doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as front, max(b) as tail, sum(b - a) as n, count(*) as k
          from gaps join bytes using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(k, 0)::bigint as n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from bytes left join parts using (doc_id)""",
    "op7_secret_scan": f"""
with texts as (select doc_id, coalesce(text, '') as t from documents), found as ({_SPANS}),
spelled as (select doc_id, kind, place, a, kind || ':' || a::bigint || ':' || (a + length(m[k]))::bigint as s from found),
each_doc as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(s, ',' order by a, place) filter (place < 3) as base, string_agg(s, ',' order by a, place) as spans from spelled group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join each_doc using (doc_id)""",
    # the layout of the given pages, stated outright: their articles are blocks of p and h1
    "op11_html_wrappers": r"""
with cut as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') as parts from pages),
bare as (select page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) as parts from cut),
decoded as (select page_id, url, list_transform(parts, lambda x: regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g')) as parts from bare),
spaced as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}]+', ' ', 'g'))) as blocks from decoded),
joined as (select page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) as text from spaced)
select page_id, url, text, length(text)::bigint as n_chars from joined""",
    "op13_fill_in_middle": """
with drawn as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
numbers as (select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as y, ('0x' || substr(h, 17, 8))::bigint as z, ('0x' || substr(h, 25, 8))::bigint as w from drawn),
formed as (select *, least(x, y) as a, greatest(x, y) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or z % 100 >= 90 then 'plain' when w % 100 < 20 then 'spm' else 'psm' end as form from numbers),
cut as (select *, left(t, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from cut""",
}
