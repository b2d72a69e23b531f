"""DuckDB SQL of the queries that SQL can express.

Absent: sharding (best-fit packing is sequential), language and quality models,
token counts and page extraction; the tests hold those against plain loops.
"""

from __future__ import annotations

from . import host_rules as hr
from .source_mix import SEED

_GAP = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_GAP}'), lambda x: x <> '')"


_OP1 = f"""
with recursive t as (select row_number() over () as r, doc_id, {_words(_LOWER)} as w from documents),
s as (select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) end) as g from t),
g as (select r, len(g) as n, unnest(g) as x from s),
links as (select a.r as a, b.r as b from g a join g b on a.x = b.x and a.r < b.r
          group by a.r, b.r having 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))),
sym as (select a, b from links union all select b, a from links),
reach(r, o) as (select r, r from s union select reach.r, sym.b from reach join sym on reach.o = sym.a),
least as (select reach.r, min(s.doc_id) as c from reach join s on s.r = reach.o group by reach.r)
select doc_id, len(g)::bigint as n_shingles, c as component_id from s join least using (r)"""

_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP6 = f"""
with items as (select cast(item_id as varchar) as id, {_TOKENS} as w from benchmark where text is not null),
patterns as (select distinct id, least(len(w), 10) as n,
               array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as x
             from (select id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, {_TOKENS} as w from documents),
sizes as (select distinct n from patterns),
windows as (select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as x
            from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select distinct windows.r, windows.i, windows.n, id from windows join patterns using (n, x)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
found as (select r, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join found using (r)"""

_FAIL = {"base": "base_failed", "symbols": f"n_symbols > {hr.MAX_SYMBOLS_PER_WORD} * greatest(n_words, 1)",
         "lines": f"n_dup_lines > {hr.MAX_DUP_LINE_SHARE} * greatest(n_lines, 1)",
         "length": f"not (word_chars / greatest(n_words, 1) between {hr.MEAN_WORD_CHARS[0]} and {hr.MEAN_WORD_CHARS[1]})"}


def _host_rate(rule: str) -> str:
    """The rule's failure rate of each host, shrunk by the moment-fitted beta prior."""
    return f"""
  rate_{rule} as (
    with h as (select source, count(*) as n, sum(case when {_FAIL[rule]} then 1 else 0 end) as f from m
               where source is not null group by source),
    s as (select sum(n) as n, count(*) as k, sum(n * n) as nn, sum(f * f / n) as q,
                 least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) as p from h),
    v as (select *, case when k > 1 then greatest(greatest(q - n * p * p, 0) - (k - 1) * p * (1 - p), 0)
                           / greatest(n - nn / n, 1) else 0 end as spread from s),
    a as (select p, least(greatest(case when spread > 0 then p * (1 - p) / spread - 1 else n / k end, 2), greatest(n / k, 2)) as z
          from v)
    select source, (f + p * z) / (n + z) as rate from h, a)"""


_OP8 = f"""
with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
             {_words("coalesce(text, '')")} as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
           from documents),
win as (select r, i, list_slice(w, i, i + 2) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from t)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from rep) group by r),
c as (select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
        coalesce(n, 0)::bigint as n_repeat_words from t left join cov using (r)),
m as (select *, n_words < {hr.MIN_WORDS} or 100 * n_repeat_words > {hr.MAX_REPEAT_PERCENT} * n_words as base_failed from c),
{",".join(_host_rate(r) for r in hr.RULES)},
bad as (select source from ({" union all ".join(f"select * from rate_{r}" for r in hr.RULES)})
        where rate > {hr.MAX_HOST_RATE} group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and bad.source is null as kept
from m left join bad on m.source = bad.source"""

_OP9 = f"""
with d as (select doc_id, source, len({_words("coalesce(text, '')")})::bigint as size,
             ('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '') || '|' || m
               || case when r > 0 then '|' || r else '' end), 1, 13))::bigint as u, m, r
      from (select *, row_number() over (partition by doc_id, source, m) - 1 as r
            from (select *, md5(coalesce(text, '')) as m from documents))),
s as (select source, sum(size)::bigint as source_size,
        ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight from d group by source),
o as (select *, 3.0::double * source_size as cap,
        coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source nulls last
          rows between unbounded preceding and 1 preceding), 0) as before,
        sum(weight) over (order by 3.0::double * source_size / weight, source nulls last
          rows between current row and unbounded following) as rest,
        sum(source_size) over () as total from s),
l as (select *, (total - before) / rest as level, cap <= weight * (total - before) / rest as capped from o),
g as (select source, source_size, case when capped then cap
        else weight * max(case when not capped then level end) over () end as target from l),
q as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from g),
c as (select d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size as extra,
        coalesce(sum(size) over (partition by d.source order by u, doc_id nulls last, m, r
          rows between unbounded preceding and 1 preceding), 0) as pos
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target,
       (case when size = 0 then 0 else whole + case when pos + size / 2 <= extra then 1 else 0 end end * size)::bigint as taken
from c"""

_OP10 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first,
        list_transform(range(0, 8), lambda g: ('0x' || substr(h, 1 + 5 * g::int, 5))::int) as v from p)
select page_id, n::bigint as payload_bytes,
  array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31) + 1, 1)))), '') as payload_digest,
  case when page_id = first or first is null then 'response' else 'revisit' end as record_type,
  case when page_id <> first or page_id is null then first end as refers_to
from f"""

_OP11 = """
with bits as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                  lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
              from (select unnest(range(0, 256)) as i)),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
             md5(coalesce(role, '')) || md5(coalesce(text, '')) as e, length(coalesce(text, '')) as chars
      from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 as h
      from (select distinct conv_id from o) cross join bits),
r as (select c.conv_id, pos, e, chars from c join o on o.conv_id = base and pos < h
      union all select conv_id, pos, e, chars from c join o using (conv_id) where pos >= h),
p as (select conv_id, row_number() over w as d, chars, md5(string_agg(e, '') over w) as key
      from r window w as (partition by conv_id order by pos rows unbounded preceding)
      union all select conv_id, 0, 0, '' from c),
n as (select key, d, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from p group by key, d),
up as (select n.key, q.key as parent from n join p q on q.conv_id = n.conv_id and q.d = n.d - 1),
kids as (select parent as key, count(*) as n_children from up group by parent),
below as (select q.key, sum((n_convs - 1) * n.chars) as saved, count(*) filter (kids.key is null) as leaves
          from n left join kids using (key) join p q on q.conv_id = n.conv_id and q.d <= n.d group by q.key),
ends as (select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids
         from (select conv_id, arg_max(key, d) as key from p group by conv_id) group by key)
select n.conv_id, n.d::bigint as depth, m.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children,
       leaves as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n join below using (key) left join kids using (key) left join ends using (key)
left join up using (key) left join n m on m.key = up.parent"""

_OP13 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             doc_id > min(doc_id) over (partition by t) as copy from d),
l as (select doc_id as id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false)::int as good, coalesce(toxic, false)::int as toxic,
             {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
              'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(copy, false)} as bad
      from w left join l on doc_id = id),
cells as (select part, concat(case when bad.A then 'A' else '' end, case when bad.B then 'B' else '' end,
                 case when bad.C then 'C' else '' end, case when bad.D then 'D' else '' end,
                 case when bad.E then 'E' else '' end) as fails, count(*) as n, sum(good) as g, sum(toxic) as x
          from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (select a.c || b.c || c.c || d.c || e.c as o from letters a join letters b on b.c <> a.c
           join letters c on c.c not in (a.c, b.c) join letters d on d.c not in (a.c, b.c, c.c)
           join letters e on e.c not in (a.c, b.c, c.c, d.c)),
steps as (select o, unnest(range(1, 6)) as step from orders),
hit as (select part, o, step, fails, n, g, x, contains(fails, substr(o, step::int, 1)) as here,
               step > 1 and length(translate(fails, substr(o, 1, step::int - 1), '')) < length(fails) as before
        from cells cross join steps),
r as (select part, o as filter_order, step::int as step,
        coalesce(sum(n) filter (not here and not before), 0)::bigint as kept,
        coalesce(sum(n) filter (here and not before), 0)::bigint as removed,
        coalesce(sum(n) filter (here and before), 0)::bigint as redundant,
        coalesce(sum(n) filter (fails = substr(o, step::int, 1)), 0)::bigint as unique_fails,
        coalesce(sum(g) filter (here and not before), 0)::bigint as good_lost,
        coalesce(sum(x) filter (here and not before), 0)::bigint as toxic_lost
      from hit group by part, o, step)
select *, (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from r"""

ORACLE: dict[str, str] = {
    "op1_ngram_join": _OP1,
    "op6_decontamination": _OP6,
    "op8_quality_rules": _OP8,
    "op9_source_mix": _OP9,
    "op10_warc": _OP10,
    "op11_prefix_trie": _OP11,
    "op13_filter_audit": _OP13,
}
