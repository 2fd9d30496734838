"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quire.llm.secret_scan import RULES, _quick

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as s from w),
t as materialized (select doc_id, unnest(s) as tok from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from t a join t b on a.tok = b.tok and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from p join s x on p.a = x.doc_id join s y on p.b = y.doc_id where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e as materialized (select a, b from l union select b, a from l),
r(node, low) as (select doc_id, doc_id from s union select e.b, r.low from r join e on e.a = r.node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.low as component_id, case when len(s.s) = 0 then 1 else count(*) over (partition by s.s) end as copies
from s join (select node, min(low) as low from r group by node) c on c.node = s.doc_id"""

OP10 = rf"""with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as ln, unnest(string_split(text, chr(10))) as line from documents),
n as (select *, len(regexp_extract_all(line, '{_WORD}')) as n from l),
c as materialized (select *, sum(n) over (partition by doc_id order by ln) as upto from n),
r as (select a.doc_id, a.ln as s, min(b.ln) as e from c a join c b on a.doc_id = b.doc_id and b.ln >= a.ln and b.upto - a.upto + a.n >= 50 group by a.doc_id, a.ln
  union select a.doc_id, max(b.ln), a.ln from c a join c b on a.doc_id = b.doc_id and b.ln <= a.ln and a.upto - b.upto + b.n >= 50 group by a.doc_id, a.ln),
x as materialized (select r.doc_id, r.s, r.e, string_agg(c.line, chr(10) order by c.ln) as run from r join c on c.doc_id = r.doc_id and c.ln between r.s and r.e group by r.doc_id, r.s, r.e),
f as (select *, row_number() over (partition by run, e - s order by doc_id, s) as rn from x),
g as (select distinct doc_id, unnest(range(s, e + 1)) as ln from f where rn > 1)
select d.doc_id, case when d.text is null then null when k.gone is null then d.text else coalesce(k.text, '') end as text, coalesce(k.total, 0) as lines_total, coalesce(k.gone, 0) as lines_removed
from documents d left join (select l.doc_id, string_agg(l.line, chr(10) order by l.ln) filter (g.ln is null) as text, count(*) as total, nullif(count(g.ln), 0) as gone from l left join g on l.doc_id = g.doc_id and l.ln = g.ln group by l.doc_id) k on d.doc_id = k.doc_id"""


def _spans(rank: int) -> str:
    """A rule's spans: the gaps between the matches and the matches, in turn, add up to the offsets."""
    rule = RULES[rank]
    pattern = _quick(rule).replace("'", "''")
    found = f"select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {rule.group}) as p, string_split_regex(t, '{pattern}') as g from d where regexp_matches(t, '{pattern}')"
    start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    spans = f"select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {start}, 'e': {start} + length(m[i]), 'n': length(p[i])}})) as x from ({found})"
    return f"select doc_id, {rank} as rank, '{rule.kind}' as kind, {str(rule.base).lower()} as base, cast(x.s as bigint) as s, cast(x.e as bigint) as e from ({spans}) where x.n >= {rule.least}"


OP9 = f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as ({" union all ".join(_spans(i) for i in range(len(RULES)))}),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(concat_ws(':', kind, s, e), ',' order by s, rank) filter (base) as base, string_agg(concat_ws(':', kind, s, e), ',' order by s, rank) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a on d.doc_id = a.doc_id"""

OP12 = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
u as materialized (select lang, x as w, count(*) as f from (select lang, unnest(w) as x from w) group by all),
t as (select lang, cast(sum(f) as bigint) as n from u group by lang),
b as materialized (select lang, x.a as a, x.b as b, count(*) as f from (select lang, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) as x from w where len(w) > 1) group by all having count(*) >= 10),
c as materialized (select lang, x.a as a, x.b as b, x.c as c, count(*) as f from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]})) as x from w where len(w) > 2) group by all having count(*) >= 10),
longer as (select lang, a, b, max(f) as m from (select lang, a, b, f from c union all select lang, b, c, f from c) group by all),
two as (select b.lang, b.a || ' ' || b.b as phrase, b.f as a, x.f as l, y.f as r, 1 as cut from b join u x on x.lang = b.lang and x.w = b.a join u y on y.lang = b.lang and y.w = b.b left join longer g on g.lang = b.lang and g.a = b.a and g.b = b.b where g.m is null or 100 * g.m < 50 * b.f),
s as (select c.lang, c.a || ' ' || c.b || ' ' || c.c as phrase, c.f as a, x.f as f1, y.f as f23, z.f as f12, v.f as f3 from c join u x on x.lang = c.lang and x.w = c.a join b y on y.lang = c.lang and y.a = c.b and y.b = c.c join b z on z.lang = c.lang and z.a = c.a and z.b = c.b join u v on v.lang = c.lang and v.w = c.c),
k as (select *, cast(1000000 as hugeint) * a * a // (cast(f1 as hugeint) * f23) as s1, cast(1000000 as hugeint) * a * a // (cast(f12 as hugeint) * f3) as s2 from s),
every as (select lang, phrase, a, l, r, cut, cast(1000000 as hugeint) * a * a // (cast(l as hugeint) * r) as score from two
  union all select lang, phrase, a, case when s1 <= s2 then f1 else f12 end, case when s1 <= s2 then f23 else f3 end, case when s1 <= s2 then 1 else 2 end, least(s1, s2) from k),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every)
select o.lang, rank, phrase, a, l, r, t.n, cast(score as bigint) as score, cut from o join t on t.lang = o.lang where rank <= 2000"""

SQL = {"op2_ngram_jaccard_join": OP2, "op9_secret_scan": OP9, "op10_line_dedup": OP10, "op12_collocations": OP12}
