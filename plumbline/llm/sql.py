"""DuckDB SQL that gives the rows of those queries that SQL can express."""

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x20\x09-\x0D]+')"

# without base elements and dot segments, which the driver's pages do not have
_NODE = r"""case when {ok} then lower(regexp_extract({u}, '^(.*?)://', 1, 's')) || '://' ||
  case lower(regexp_extract({u}, '^(.*?)://', 1, 's')) when 'http' then regexp_replace({h}, ':(80)?$', '') when 'https' then regexp_replace({h}, ':(443)?$', '') else {h} end ||
  case regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') when '' then '/' else regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') end || regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1, 's') end"""
_HOST = rf"translate(regexp_extract({{u}}, '^.*?://([^/?#]*)', 1, 's'), {FOLD})"

OP1 = rf"""
with recursive p as (select page_id, url, contains(url, '://') ok,
  regexp_replace(html, '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b[^>]*>|\z)|<textarea\b.*?(?:</textarea\b[^>]*>|\z)', '', 'gis') html from pages),
h as (
  select page_id, url, html, ok, case when ok then {_HOST.format(u='url')} else '' end host, case when ok then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end path from p),
n as (
  select *, {_NODE.format(ok='ok', u='url', h='host')} node,
    case when (host = 'example.com' or host like '%.example.com') and path like '/en/7%' then 'example.com/en/7' when (host = 'example.net' or host like '%.example.net') and path like '/de/8%' then 'example.net/de/8'
         when (host = 'com' or host like '%.com') and path like '/en/%' then 'com/en/' when (host = 'net' or host like '%.net') and path like '/de/%' then 'net/de/' when (host = 'org' or host like '%.org') and path like '/es/%' then 'org/es/' end rule from h),
v as (select *, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' end own from n),
refs as (
  select url, node, unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')
                        || regexp_extract_all(html, '<link\b[^>]*\bhref\s*=\s*["'']?\s*([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1, 'is')
                        || regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')) ref0 from v where node is not null and html is not null),
dec0 as (select url, node, replace(replace(replace(ref0, '&quot;', '"'), '&#38;', '&'), '&amp;', '&') ref from refs),
ab as (select node src, case when regexp_matches(ref, '^[a-z][a-z0-9+.-]*://', 'i') then ref when ref = '' or ref like '#%' or regexp_matches(ref, '^[a-z][a-z0-9+.-]*:', 'i') then null
  when ref like '//%' then regexp_extract(url, '^(.*?:)//', 1, 's') || ref when ref like '/%' then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || ref when ref like '?%' then regexp_extract(url, '^([^?#]*)', 1, 's') || ref
  else regexp_replace(regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's'), '/?$', '/') || ref end dst from dec0),
e0 as (select src, {_NODE.format(ok="contains(dst, '://')", u='dst', h=_HOST.format(u='dst'))} dst from ab where dst is not null),
e as (select src, dst from e0 union select dst, src from e0),
reach(a, b) as (select distinct node, node from v where node is not null union select a, dst from reach join e on b = src),
comp as (select a node, min(b) c from reach group by 1),
dec as (select c, bool_or(own = 'allow') al, bool_or(own = 'block') bl from v join comp using (node) group by 1)
select page_id, host, path, rule, coalesce(own, case when al then 'allow' when bl then 'block' end, 'allow') verdict
from (select page_id, coalesce(host, '') host, coalesce(path, '') path, rule, own, node from v) x left join comp using (node) left join dec using (c)
"""

OP4 = rf"""
with recursive w as (select doc_id, {BLANK_WORDS} ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end sh from w),
x as (select doc_id, unnest(sh) g from s),
c as (select a.doc_id a, b.doc_id b, count(*) common from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * common >= 85 * (len(sa.sh) + len(sb.sh) - common)),
e as (select a, b from l union select b, a from l),
reach(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, e.b from reach r join e on r.other = e.a)
select s.doc_id, cast(len(sh) as bigint) n_shingles, component_id from s join (select doc_id, min(other) component_id from reach group by 1) using (doc_id)
"""

_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
with b as (select cast(item_id as varchar) item_id, {_ALNUM} ws from benchmark),
win as (select distinct item_id, greatest(least(len(ws), 10), 1) n, array_to_string(ws[i:i + 9], ' ') g from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from b where len(ws) > 0)),
d as (select doc_id, {_ALNUM} ws from documents),
grams as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, (select distinct n from win))),
hit as (select doc_id, grams.n, i, item_id from grams join win on win.n = grams.n and win.g = grams.g),
pos as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by 1),
its as (select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id)), ',') ids from hit group by 1)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""


def _closing(i: int) -> str:
    """One closing document a source: the one left whose size is nearest to the gap, if that comes nearer."""
    left = "q is not null and not once and abs(size - gap) < gap"
    return f"""c{i} as (select *, {left} and row_number() over (partition by source, {left} order by abs(size - gap), q, doc_id) = 1 closing from g{i - 1}),
g{i} as (select * exclude (once, gap, closing), once or closing once, gap - coalesce(sum(size) filter (where closing) over (partition by source), 0) gap from c{i})"""


OP9 = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
         (cast(cast('0x' || substr(md5('mix:' || doc_id), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 u from documents),
src as (select source, cast(sum(size) as bigint) source_size from d group by 1),
w as (select *, [5.0::double, 2.0::double, 1.0::double][cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as int)] w, source_size * 3.0::double most from src),
o as (select *, row_number() over (order by most / w, source asc nulls last) ord from w),
r as (select *, (sum(source_size) over () * 1.0::double - coalesce(sum(most) over (order by ord rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by ord rows between current row and unbounded following) rate from o),
f as (select *, most / w <= rate filled from r),
l as (select min_by(rate, ord) filter (where not filled) lam from f),
t as (select source, source_size, case when filled or lam is null then most else w * lam end target from f, l),
z as (select *, cast(floor(sqrt(cast(size as double)) * 16) as bigint) weight from d),
h as (select source, size, weight, count(*) n from z where size > 0 group by all),
fa as (
  select h.*, (target - 3.0::double * coalesce(sum(n * size) over (partition by h.source order by size desc rows between unbounded preceding and 1 preceding), 0))
              / sum(n * size * weight) over (partition by h.source order by size desc rows between current row and unbounded following) factor
  from h join t on h.source is not distinct from t.source),
fs as (select source, max_by(factor, size) factor from fa where factor * weight <= 3.0::double * (1 + 1e-9::double) group by 1),
r0 as (
  select z.doc_id, z.size, z.source, u, source_size, target, least(3.0::double, coalesce(factor * weight, 0)) r
  from z join t on z.source is not distinct from t.source left join fs on z.source is not distinct from fs.source),
r1 as (select *, case when abs(r - round(r)) < 1e-9::double then round(r) else r end rate from r0),
c as (select *, cast(floor(rate) as bigint) copies, rate - floor(rate) p from r1),
q as (select *, target - sum(copies * size) over (partition by source) rest, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end q from c),
k as (select *, sum(size) over (partition by source, q is null order by q, doc_id) cum from q),
g0 as (select *, coalesce(q is not null and cum <= rest, false) once, rest - coalesce(max(cum) filter (where q is not null and cum <= rest) over (partition by source), 0) gap from k),
{_closing(1)},
{_closing(2)},
{_closing(3)}
select doc_id, size, source_size, target, cast((copies + cast(once as int)) * size as bigint) taken from g3
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
with d as (select row_number() over () k, doc_id, {_TERMS} ws from documents),
i as (select row_number() over () q, item_id, {_TERMS} ws from benchmark),
tot as (select count(*) n, cast(sum(len(ws)) as bigint) l from d where len(ws) > 0),
it as (select q, item_id, term, count(*) times from (select q, item_id, unnest(ws) term from i) group by all),
p as (select k, doc_id, term, n, count(*) tf from (select k, doc_id, cast(len(ws) as bigint) n, unnest(ws) term from d) where term in (select term from it) group by all),
w as (select term, cast(floor(1000 * ln((2 * tot.n + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from p, tot group by term, tot.n),
c as (select k, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * p.n * tot.n) // tot.l)))) c from p join w using (term), tot),
s as (select q, item_id, k, doc_id, cast(sum(times * c) as bigint) score from c join it using (term) group by all having sum(times * c) > 0),
r as (select *, row_number() over (partition by q order by score desc, doc_id asc nulls last) rank from s)
select item_id, cast(rank as int) rank, doc_id, score from r where rank <= 20
"""
