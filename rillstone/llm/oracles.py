"""DuckDB SQL for the queries that SQL can express.

op3, op6 and op9 have none: packing and trained models aren't relational; tests
hold them against brute force, plain versions and held-out figures.
"""

from __future__ import annotations

from rillstone.llm.token_counts import public_vocabulary
from rillstone.llm.url_filters import MIN_CONFIDENCE, MIN_PAGES, MIN_SUPPORT, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
firsts as (select k, min(doc_id) as f from win group by k),
gone as (select distinct doc_id, i + j as p from win join firsts using (k), (select unnest(range(0, 13)) as j) where f < doc_id),
kept as (select d.doc_id, x.p, d.w[x.p] as word from d, lateral (select unnest(range(1, len(w) + 1)) as p) x
  where not exists (select 1 from gone g where g.doc_id = d.doc_id and g.p = x.p)),
text_kept as (select doc_id, string_agg(word, ' ' order by p) as t from kept group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join text_kept using (doc_id)"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


def _op2() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    name = " ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in longest)
    says = " ".join(f"when {_fits(h, p)} then '{v}'" for h, p, v in longest)
    return f"""
with recursive u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path, regexp_extract(coalesce(url, ''), '(?s)\\?([^#]*)', 1) as q from u),
t as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, list_sort(list_distinct(list_filter(
  list_transform(string_split(coalesce(host, ''), '.'), lambda x: 'h:' || x) || list_transform(string_split(coalesce(path, ''), '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
  || list_transform(string_split(q, '&'), lambda x: 'q:' || split_part(x, '=', 1)), lambda x: len(x) > 2))) as tokens from s),
told as (select doc_id, bool_or(quality = 0) as bad from labels where quality is not null group by doc_id having bool_or(quality = 0) = bool_and(quality = 0)),
basket as (select tokens, bad, row_number() over () as b from t join told on page_id = doc_id),
n as (select count(*) as n, avg(case when bad then 1.0 else 0.0 end) as rate from basket where len(tokens) > 0 or bad),
sub(b, bad, tokens, k, chosen) as (select b, bad, tokens, 0, cast([] as varchar[]) from basket
  union all select b, bad, tokens, k + 1, case when take then list_append(chosen, tokens[k + 1]) else chosen end from sub, (values (true), (false)) v(take) where k < len(tokens)),
mined as (select chosen, sum(case when bad then 1 else 0 end) / count(*) as confidence from sub where k = len(tokens) and len(chosen) > 0 group by chosen
  having sum(case when bad then 1 else 0 end) >= ceil(greatest({MIN_SUPPORT} * (select n from n), {MIN_PAGES}))
  and sum(case when bad then 1 else 0 end) / count(*) >= {MIN_CONFIDENCE} and sum(case when bad then 1 else 0 end) / count(*) > (select rate from n)),
hit as (select page_id, max(struct_pack(c := confidence, r := array_to_string(chosen, ' '))).r as mined from t, mined where list_has_all(tokens, chosen) group by page_id),
ruled as (select page_id, host, path, case {name} end as rule, case {says} end as says from t)
select page_id, host, path, rule, coalesce(says, case when hit.page_id is not null then 'block' else 'allow' end) as verdict,
case when says is null then mined end as mined from ruled left join hit using (page_id)"""


OP4 = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
pat as (select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as k
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
win as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from pat) where len(w) >= n)),
found as (select doc_id, n, i, item from win join pat using (n, k)),
hit as (select doc_id, count(distinct i + j) as h from found, (select unnest(range(0, 10)) as j) where j < n group by doc_id),
items as (select doc_id, count(*) as c, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h, 0) as bigint) as n_hit, cast(coalesce(c, 0) as bigint) as n_items,
sha256(coalesce(s, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated from d left join hit using (doc_id) left join items using (doc_id)"""

OP5 = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.k = b.k and a.doc_id <> b.doc_id group by all),
link as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) as (select doc_id, doc_id from d union select reach.x, link.y from reach join link on reach.y = link.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(r.c as bigint) as component_id
from d left join n using (doc_id) join (select x, min(y) as c from reach group by x) r on r.x = d.doc_id"""



def _op7(path: str) -> str:
    """Greedy longest match of each distinct word, a piece a step, in hex; a word that no piece goes on with is one token."""
    return f"""with recursive v as (select distinct hex(from_base64(piece)) as p from read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'rank': 'BIGINT'}})),
w as (select doc_id, unnest({WORDS}) as x from documents),
u as (select distinct x, hex(encode(' ' || x)) as h from w),
g(x, h, n) as (select x, h, 0 from u
  union all select x, substr(h, max(length(p)) + 1), n + 1 from (select x, h, n, unnest(range(2, length(h) + 1, 2)) as l from g) s join v on v.p = substr(s.h, 1, l) group by x, h, n),
c as (select x, n from g where h = ''),
t as (select doc_id, count(*) as n_words, sum(coalesce(n, 1)) as n_tokens from w left join c using (x) group by doc_id)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_tokens, 0) as bigint) as n_tokens from documents d left join t using (doc_id)"""


OP8 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as s from pages),
f as (select s, min(page_id) as f from p where n >= 100 group by s)
select page_id, cast(n as bigint) as payload_bytes, s as payload_digest, case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
case when n >= 100 and page_id <> f then f end as refers_to from p left join f using (s)"""

# Written from the rule as it is dealt, with its limits as numbers: a line of more than 50 distinct documents of a host
# goes; documents with one set of lines are one; who keeps fewer than 50 words or 30 % goes.
OP10 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
win as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select doc_id, count(distinct i + j) as r from win join (select doc_id, k from win group by all having count(*) > 1) using (doc_id, k), (select unnest(range(0, 3)) as j) group by doc_id),
lines as (select doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) as x from (select doc_id, source, unnest(l) as x from d)),
sets as (select doc_id, string_agg(x, chr(10) order by x) as lines_held from (select distinct doc_id, x from lines) group by doc_id),
often as (select source, x from lines join sets using (doc_id) group by source, x having count(distinct lines_held) > 50),
gone as (select doc_id, sum(len(string_split(x, ' '))) as g from lines where exists (select 1 from often o where o.source is not distinct from lines.source and o.x = lines.x) group by doc_id),
s as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(coalesce(r, 0) as bigint) as n_repeat_words, cast(coalesce(g, 0) as bigint) as n_line_words from d left join rep using (doc_id) left join gone using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select *, not base_failed and n_words - n_line_words >= 50 and n_words - n_line_words >= 0.3 * n_words as kept from b"""

ORACLE = {
    "op1_substring_dedup": OP1,
    "op2_url_filters": _op2(),
    "op4_benchmark_decontamination": OP4,
    "op5_ngram_jaccard_join": OP5,
    "op7_token_counts": _op7(public_vocabulary()),
    "op8_warc": OP8,
    "op10_quality_rules": OP10,
}
