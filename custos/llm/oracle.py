"""DuckDB SQL of the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"


def _level(name: str, path: list[str], weight: str, above: str) -> str:
    """One level of top-down water-filling: CTE ``name`` with the share of each node."""
    keys, up = ", ".join(path), path[:-1]
    part = f"partition by {', '.join(up)} " if up else ""
    join = " and ".join(f"c.{c} is not distinct from p.{c}" for c in up) or "true"
    order = f"{part}order by cap::double / w::double, {path[-1]} nulls first"
    return f"""
{name}_c as (select {keys}, (sum(tokens) * 3)::hugeint cap, max({weight})::hugeint w from leaf group by {keys} having sum(tokens) > 0),
{name}_s as (select c.*, p.share from {name}_c c join {above} p on {join}),
{name}_o as (select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)::hugeint before,
    (sum(w) over ({order} rows between current row and unbounded following))::hugeint after from {name}_s),
{name}_f as (select *, cap * after <= (share - before) * w as is_full from {name}_o),
{name}_g as (select *, (sum(case when is_full then cap else 0 end) over ({part}))::hugeint full_cap,
    (sum(case when is_full then 0 else w end) over ({part}))::hugeint open_w from {name}_f),
{name} as (select {keys}, case when is_full then cap else ((share - full_cap) * w) // open_w end::hugeint share from {name}_g)"""


_NUMBER = "coalesce(try_cast(nullif(regexp_extract({}, '([0-9]+)$', 1), '') as int), 0)"

_MIX = f"""
with d as (
  select doc_id, lang, source, 'domain' || ({_NUMBER.format('source')} % 4) as domain, lang as language, source as origin,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as tokens from documents),
leaf as (select domain, language, origin, sum(tokens)::hugeint tokens,
    {_NUMBER.format('domain')} + 1 as w_domain, case when language = 'en' then 4 when language in ('de', 'fr') then 2 else 1 end as w_language,
    {_NUMBER.format('origin')} % 3 + 1 as w_origin from d group by domain, language, origin),
root as (select (sum(tokens) * 70 // 100)::hugeint share from leaf),
{_level('l1', ['domain'], 'w_domain', 'root')},
{_level('l2', ['domain', 'language'], 'w_language', 'l1')},
{_level('l3', ['domain', 'language', 'origin'], 'w_origin', 'l2')},
plan as (select leaf.domain, leaf.language, leaf.origin, l3.share budget, l3.share // leaf.tokens whole, l3.share % leaf.tokens rest
  from leaf join l3 on leaf.domain is not distinct from l3.domain and leaf.language is not distinct from l3.language
    and leaf.origin is not distinct from l3.origin where leaf.tokens > 0),
p as (select d.*, budget, whole, rest, md5('mix|' || whole || '|' || doc_id) place from d join plan
  on d.domain is not distinct from plan.domain and d.language is not distinct from plan.language and d.origin is not distinct from plan.origin),
q as (select *, sum(tokens) over (partition by domain, language, origin order by place) upto from p),
z as (select *, min(case when upto > rest then place end) over (partition by domain, language, origin) stop from q)
select doc_id, lang, source, tokens::bigint n_tokens,
  (whole + case when rest > 0 and place < stop then 1 else 0 end)::bigint copies, budget::bigint leaf_budget
from z where whole + case when rest > 0 and place < stop then 1 else 0 end > 0"""

def _shingled(name: str, key: str, table: str) -> str:
    """CTE ``name``: distinct five-word shingles of each row (its whole sequence if shorter)."""
    lower = "lower(text)"
    return f"""
{name}_w as (select {key}, regexp_extract_all({lower}, '{_WORD}') w from {table} where text is not null),
{name} as (select distinct {key}, array_to_string(w[i:i + 4], ' ') s
  from (select {key}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from {name}_w where len(w) > 0))"""


_CONTAINED = f"""
with {_shingled('i', 'item_id', 'benchmark')}, {_shingled('d', 'doc_id', 'documents')},
size as (select item_id, count(*) n from i group by item_id),
hit as (select doc_id, item_id, count(*) found from i join d using (s) group by doc_id, item_id)
select doc_id, item_id, n::bigint n_shingles, found::bigint n_found from hit join size using (item_id) where found * 100 >= n * 80"""

_LINKED = """
with recursive c as (select conv_id, turn, role, text, conv_id || ':' || turn as call_id from conversations where role in ('system', 'user')),
ids as (select distinct conv_id, turn, call_id from c),
edge as (select distinct a.call_id child, b.call_id parent from ids a join ids b on a.conv_id = b.conv_id and b.turn in (a.turn - 1, a.turn - 2)),
chain(call_id, level) as (select call_id, 0 from ids union select child, level + 1 from chain join edge on parent = call_id),
lev as (select call_id, max(level) level from chain group by call_id),
res as (select conv_id || ':' || (turn - 1) call_id, min(struct_pack(seq := turn, content := text)).content content, count(*) n
  from conversations where role = 'assistant' group by 1)
select 'call' kind, conv_id conversation, c.call_id, null::bigint seq, role tool, level::int as level, coalesce(n, 0)::bigint n_results, text is not null valid,
  case when text is null then 'missing text' else '' end problems,
  '{"arguments":{' || case when text is null then '' else '"text":' || to_json(text) || ',' end || '"turn":' || turn || '},"id":' || to_json(c.call_id)
  || ',"result":' || coalesce(to_json(content)::varchar, 'null') || ',"tool":' || to_json(role) || '}' message
from c join lev using (call_id) left join res using (call_id)
union all
select 'result', null, r.call_id, r.turn, null, null, null, ids.call_id is not null, case when ids.call_id is null then 'no such call' else '' end,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"id":' || to_json(r.call_id) || ',"seq":' || r.turn || '}'
from (select conv_id || ':' || (turn - 1) call_id, turn, text from conversations where role = 'assistant') r left join ids on r.call_id = ids.call_id"""

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_RESAMPLED = f"""
with recursive step(i, r, n) as (select i, i, 0 from range(256) t(i) union all
    select i, case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, n + 1 from step where n < 8),
tab as (select list(r order by i) crc from step where n = 8),
f as (select 'd' side, doc_id id, rn, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_SMALL}'), '{_FEATURE_WORD}')) w
    from (select *, row_number() over () rn from documents)
  union all select 'b', item_id, 0, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_SMALL}'), '{_FEATURE_WORD}')) from benchmark),
g as (select side, id, rn, w, count(*) c from f group by all),
bytes as (select w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint) b
    from (select distinct w from g)),
bucket as (select w, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda r, x: xor(r >> 8, crc[(xor(r, x) & 255) + 1])), 4294967295) % 10000 k
    from bytes, tab),
h as (select side, id, rn, c, k from g join bucket using (w)),
n as (select k, coalesce(sum(c) filter (side = 'd'), 0)::double s, coalesce(sum(c) filter (side = 'b'), 0)::double t from h group by k),
gain as (select k, floor(1000 * ln((t + 1) * ((select sum(s) from n) + 10000) / ((s + 1) * ((select sum(t) from n) + 10000))))::bigint g from n),
doc as (select rn, sum(c)::bigint n_features, sum(c * g)::bigint weight from h join gain using (k) where side = 'd' group by rn),
v as (select doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h
  from (select *, row_number() over () rn from documents) left join doc using (rn)),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score from v),
able as (select *, row_number() over (order by score desc, doc_id) r, count(*) over () total from z where n_features >= 20)
select z.doc_id, z.n_features::bigint n_features, z.weight::bigint weight, z.score::bigint score,
  (case when r <= total * 10 // 100 then r end)::bigint as "rank" from z left join able using (doc_id)"""

_INFILLED = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u,
    sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
g as (select *, len(u) n, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2,
    ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end form from g),
p as (select *, array_to_string(u[1:a], '') x, array_to_string(u[a + 1:b], '') y, array_to_string(u[b + 1:], '') z from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y
    else '<S>' || z || '<P>' || x || '<M>' || y end o from p),
r as (select *, case form when 'plain' then o
    when 'psm' then split_part(split_part(o, '<P>', 2), '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
    else split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<P>', 1) end back from o)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(x) end::bigint prefix_chars,
  case when form <> 'plain' then length(y) end::bigint middle_chars, sha256(o) output_sha256, sha256(back) restored_sha256 from r"""

_JUDGED = rf"""
with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_SMALL}') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda q: q <> '' and not regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) q from pages),
c as (select *, case when contains(url, '://') then regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '')
    || regexp_replace(path, '(/index\.html?|\.html?|/)$', '') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end canon from u),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, url, max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) best from c join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, url),
listed as (select distinct canon from c where regexp_matches(host, '(^|\.)(spam|casino)[^.]*\.') and canon is not null)
select c.page_id, host, path, best.rule as rule,
  coalesce(best.verdict, case when listed.canon is not null then 'block' else 'allow' end) verdict
from c left join m on c.page_id = m.page_id and c.url = m.url left join listed on c.canon = listed.canon"""

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": _CONTAINED,
    "op7_tool_calls": _LINKED,
    "op8_mixing": _MIX,
    "op11_resample": _RESAMPLED,
    "op12_fill_in_middle": _INFILLED,
    "op13_url_filter": _JUDGED,
}
