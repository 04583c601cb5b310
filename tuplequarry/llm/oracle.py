"""SQL (DuckDB) for the queries that SQL can express. The other queries are tested against brute force in tests/llm."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
with d as (select doc_id, coalesce(hex(encode(text)), '') as h from documents),
n as (select doc_id, h, (length(h) // 2)::bigint as n_bytes from d),
starts as (select doc_id, unnest(range(0, n_bytes - 399)) as p, h from n where n_bytes >= 400),
marked as (select doc_id, p, substr(h, 2 * p + 1, 800) as s from starts),
twice as (select md5(s) as m from marked group by 1 having count(*) > 1),
hit as (select doc_id, p from marked where md5(s) in (select m from twice)),
runs as (
  select doc_id, min(p) as s, max(p) + 400 as e from (
    select doc_id, p, sum(new) over (partition by doc_id order by p) as g from (
      select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as new from hit))
  group by doc_id, g),
gaps as (
  select doc_id, lag(e, 1, 0) over (partition by doc_id order by s) as a, s as b from runs
  union all select n.doc_id, max(runs.e), max(n.n_bytes) from runs join n using (doc_id) group by n.doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from gaps join n using (doc_id) group by doc_id),
removed as (select doc_id, sum(e - s)::bigint as n_removed, count(*)::bigint as n_spans from runs group by 1),
-- passages: runs of repeated strings of 256 bytes that hold more than 50 words
marked2 as (select doc_id, p, md5(substr(h, 2 * p + 1, 512)) as m from (select doc_id, unnest(range(0, n_bytes - 255)) as p, h from n where n_bytes >= 256)),
hit2 as (select doc_id, p from marked2 where m in (select m from marked2 group by 1 having count(*) > 1)),
runs2 as (
  select doc_id, min(p) as s, max(p) + 256 as e from (
    select doc_id, p, sum(new) over (partition by doc_id order by p) as g from (
      select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 256 then 0 else 1 end as new from hit2))
  group by doc_id, g),
mask as (select doc_id, list_aggregate(list_transform(regexp_extract_all(h, '..'), lambda x: case when x in ('20', '09', '0A', '0B', '0C', '0D') then ' ' else 'x' end), 'string_agg', '') as m from n where doc_id in (select doc_id from runs2)),
passages as (select doc_id, sum(e - s)::bigint as n_passage_bytes from runs2 join mask using (doc_id) where len(regexp_extract_all(substr(m, s + 1, e - s), 'x+')) > 50 group by 1)
select n.doc_id, n.n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256, coalesce(n_passage_bytes, 0)::bigint as n_passage_bytes
from n left join removed using (doc_id) left join kept using (doc_id) left join passages using (doc_id)
"""

OP4 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, html, sha1(html) as hex, min(page_id) over (partition by html) as first from p),
b as (select *, list_aggregate(list_transform(string_split(hex, ''), lambda c: right(lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0'), 4)), 'string_agg', '') as bits from s)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * (bits[5 * i + 1])::int + 8 * (bits[5 * i + 2])::int + 4 * (bits[5 * i + 3])::int + 2 * (bits[5 * i + 4])::int + (bits[5 * i + 5])::int)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from b
"""

OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, md5(list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
links as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by 1, 2, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
low as (select u, min(v) as c from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(low.c, w.doc_id)) as component_id
from w left join n using (doc_id) left join low on low.u = w.doc_id
"""

OP7 = r"""
with rules(h, p, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select page_id, host, path, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as k
  from u left join rules on (host = h or host like '%.' || h) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""

OP10 = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as m, list_aggregate(list_slice(w, i, i + least(len(w), 10) - 1), 'string_agg', ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
pos as (
  select doc_id, m, i, list_aggregate(list_slice(w, i, i + m - 1), 'string_agg', ' ') as s
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from dw, (select distinct m from win) where len(w) >= m)),
hit as (select doc_id, pos.m, i, item_id from pos join win on pos.s = win.s and pos.m = win.m),
words as (select doc_id, count(distinct j)::bigint as n_hit from (select doc_id, unnest(range(i, i + m)) as j from hit) group by 1),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by 1)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""

QUALITY_BASE = r"""
with d as (select row_number() over () as r, doc_id, coalesce("text", '') as t, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select r, x from d, unnest(string_split(t, chr(10))) as u(x) where regexp_matches(x, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct x) as n from lines group by r),
grams as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from d, unnest(range(1, len(w) - 1)) as u(i)),
twice as (select r, i, count(*) over (partition by r, a, b, c) as n from grams),
hit as (select r, count(distinct i + k) as n from twice, range(3) as u(k) where n > 1 group by r)
select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words
from d left join dup using (r) left join hit using (r)
"""
