"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

from shutterlake.llm.quality_rules import CLASS_SHARES, WORD_SHARES, QualityParams
from shutterlake.llm.url_filter import DEFAULT_RULES


def url_filter_sql(rules=DEFAULT_RULES, default_verdict: str = "allow") -> str:
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for v, r in rules)
    return f"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), parts as (
  select page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest
), rules(rule, rule_host, rule_path, verdict) as (values {values})
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, '{default_verdict}') as verdict
from parts p left join lateral (
  select rule, verdict from rules
  where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  order by length(rule) desc, length(rule_host) desc, rule desc limit 1
) b on true
"""


def quality_sql(p: QualityParams = QualityParams()) -> str:
    languages = sorted(set(CLASS_SHARES) & set(WORD_SHARES))
    class_rows = ", ".join(f"('{n}', {i}, {v!r})" for n in languages for i, v in enumerate(CLASS_SHARES[n]))
    word_rows = ", ".join(
        f"('{n}', '{w}', {v!r})" for n in languages for w, v in [*WORD_SHARES[n].items(), ("", 1.0 - sum(WORD_SHARES[n].values()))]
    )
    gap = "sqrt(greatest(0, sum((case when x > 0 then x * log2(2 * x / (x + y)) else 0 end + case when y > 0 then y * log2(2 * y / (x + y)) else 0 end) / 2)))"
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, lang from documents),
w as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from
  (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)
),
nw as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars from w group by doc_id),
g as (
  select doc_id, i, case when lead(w, 4) over o is not null then
    concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) end as gram
  from w window o as (partition by doc_id order by i)
),
twice as (select doc_id, gram from g where gram is not null group by all having count(*) > 1),
rep as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from g join twice using (doc_id, gram), (select unnest(range(5)) as k) group by doc_id
),
lines as (
  select doc_id, count(*) - count(distinct l) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id
),
cc as (
  select d.doc_id, lang, n, k, case k
    when 0 then n - length(regexp_replace(t, '\p{{Ll}}+', '', 'g')) when 1 then n - length(regexp_replace(t, '\p{{Lu}}+', '', 'g'))
    when 2 then n - length(regexp_replace(t, '\p{{N}}+', '', 'g')) when 3 then n - coalesce(word_chars, 0) end as c
  from (select *, length(t) as n from d) d left join nw using (doc_id), (select unnest(range(4)) as k)
),
cd as (
  select doc_id, {gap} as class_distance from (
    select doc_id, v.y, case when v.k < 4 then c else n - total end / n as x
    from (select *, sum(c) over (partition by doc_id) as total from cc where n >= {p.guard_chars}) c
    join (values {class_rows}) v(lang, k, y) on v.lang = c.lang and (v.k = c.k or v.k = 4 and c.k = 0)
  ) group by doc_id
),
wr as (
  select doc_id, n_words, v.w, v.y from nw join d using (doc_id)
  join (values {word_rows}) v(lang, w, y) on v.lang = d.lang where n_words >= {p.guard_words}
),
wc as (select wr.doc_id, wr.w, any_value(y) as y, any_value(n_words) as n, count(w.w) as c from wr left join w on w.doc_id = wr.doc_id and w.w = wr.w group by all),
wd as (
  select doc_id, {gap} as word_distance from (
    select doc_id, y, case when w <> '' then c else n - sum(c) over (partition by doc_id) end / n as x from wc
  ) group by doc_id
),
r as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, class_distance, word_distance
  from d left join nw using (doc_id) left join rep using (doc_id) left join lines using (doc_id)
  left join cd using (doc_id) left join wd using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {p.min_words} or 100 * n_repeat_words > {p.max_repeat_percent} * n_words as base_failed,
  not (n_words < {p.min_words} or 100 * n_repeat_words > {p.max_repeat_percent} * n_words)
    and not coalesce(class_distance > {p.max_class_distance}, false) and not coalesce(word_distance > {p.max_word_distance}, false) as kept
from r
"""


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""

SQL = {"op3_url_filter": url_filter_sql(), "op4_quality_rules": quality_sql(), "op7_warc": WARC_SQL}
