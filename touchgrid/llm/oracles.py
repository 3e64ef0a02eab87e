"""SQL (DuckDB) of those training-data queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
with d as (select row_number() over () as rid, doc_id, {_ALNUM} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_ALNUM} as w from benchmark),
bw as (select distinct item, n, array_to_string(w[i + 1 : i + n], ' ') as win from (select item, w, least(10, len(w)) as n, unnest(range(len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select rid, n, i, array_to_string(w[i + 1 : i + n], ' ') as win from (select rid, w, n, unnest(range(greatest(0, len(w) - n + 1))) as i from d, lens)),
h as (select dw.rid, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.win = bw.win),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from h) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rid, item from h) group by rid)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.names, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join t using (rid)"""

PHRASES = f"""
with d as (select row_number() over () as rid, doc_id, {_SPACED.format(x="coalesce(text, '')")} as w from documents),
win as (select rid, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') as k from (select rid, doc_id, w, unnest(range(greatest(0, len(w) - 12))) as i from d where doc_id is not null)),
first as (select k, min(doc_id) as doc from win group by k),
gone as (select distinct rid, unnest(range(i, i + 13)) as p from win join first using (k) where first.doc < win.doc_id),
kept as (select w.rid, string_agg(x, ' ' order by p) as text from (select rid, unnest(w) as x, unnest(range(len(w))) as p from d) w anti join gone on gone.rid = w.rid and gone.p = w.p group by w.rid),
n as (select rid, count(*) as n from gone group by rid)
select d.doc_id, len(d.w) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join n using (rid) left join kept using (rid)"""

LINES = f"""
with d as (select row_number() over () as rid, coalesce(doc_id, -9223372036854775808) as doc, doc_id, text from documents),
l as (select rid, doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d where text is not null),
s as (select rid, doc, i, line, list_sort(list_distinct({_SPACED.format(x="line")})) as w from l),
p as (select rid, doc, i, w, array_to_string(w, ' ') as k, len(w) as n from s where len(w) > 0),
c as (select k, any_value(w) as w, any_value(n) as n, min((doc, i)) as first from p group by k),
df as (select t, count(*) as f from (select unnest(w) as t from c) group by t),
o as (select k, t, row_number() over (partition by k order by f, t) as r from (select k, unnest(w) as t from c) join df using (t)),
pre as (select o.k, o.t, c.n from o join c using (k) where o.r <= c.n - ceil(0.8 * c.n - 1e-9) + 1),
cand as (select distinct a.k as a, b.k as b from pre a join pre b on a.t = b.t and a.k < b.k and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
m as (select cand.a, cand.b from cand join c x on x.k = cand.a join c y on y.k = cand.b where len(list_intersect(x.w, y.w)) >= 0.8 * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
pairs as (select a, b from m union all select b, a from m),
near as (select pairs.a as k, count(*) as links, min(c.first) as first from pairs join c on c.k = pairs.b group by pairs.a),
gone as (select p.rid, p.i from p join c using (k) left join near using (k) where (p.doc, p.i) <> c.first or near.first < c.first),
own as (select p.rid, sum(near.links) as links from p join c using (k) join near using (k) where (p.doc, p.i) = c.first group by p.rid),
g as (select rid, count(*) as n from gone group by rid),
kept as (select rid, string_agg(line, chr(10) order by i) as text from l anti join gone using (rid, i) group by rid)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(g.n, 0) as n_removed, coalesce(cast(own.links as bigint), 0) as n_links, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join g using (rid) left join own using (rid) left join kept using (rid)"""

# The patterns stand here once more, so that a slip in the operator's shows.  This engine has no look-around: a key is a
# whole run of 40 key characters, and a host or an address is cut out of its run.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_ADDRESS = r"""https?://[^\x09-\x0D\x20"'<>]+""".replace("'", "''")
_PATTERNS = (_ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/]+", f"[a-z0-9.-]*?{_ADDRESS}|[a-z0-9.-]+")
_SCOPE = 400


def _spans(name: str, kind: int, source: str) -> str:
    """(rid, s, kind, e, m): the matches of a pattern with their offsets; text between matches gives them."""
    pattern = _PATTERNS[kind]
    cut = f"select rid, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from {source}"
    one = "select rid, ms, ps, unnest(range(1, len(ms) + 1)) as i from " + f"({cut})"
    at = "coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
    return f"{name} as (select rid, cast(s as bigint) as s, {kind} as kind, cast(s + length(m) as bigint) as e, m from (select rid, {at} as s, ms[i] as m from ({one})))"


_JOINED = "string_agg(['assign', 'access', 'hex', 'key', 'endpoint'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind)"
_CLOSE = f"w.s between p.s - {_SCOPE} and p.e + {_SCOPE}"

SECRETS = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
{_spans("m0", 0, "d")}, {_spans("m1", 1, "d")}, {_spans("m2", 2, "d")},
base as (select * from m0 where length(regexp_extract(m, '{_PATTERNS[0]}', 2)) >= 6 union all select * from m1 where length(m) >= 20 union all select * from m2 where length(m) >= 24),
ids as (select * from m1 where length(m) >= 20),
near as (select * from d where rid in (select rid from ids)),
{_spans("m3", 3, "near")}, {_spans("m4", 4, "near")},
keys as (select * from m3 w where length(m) = 40 and exists (select 1 from ids p where p.rid = w.rid and {_CLOSE})),
runs as (select *, regexp_extract(m, '{_ADDRESS}') as url from m4),
hosts as (select rid, s, kind, e, regexp_extract(left(m, length(m) - length(url)), '^[a-z0-9.-]*[a-z0-9-]\\.amazonaws\\.com') as m from runs),
addresses as (select rid, e - length(url) as s, kind, e, url as m from runs where url <> '' union all select rid, s, kind, s + length(m) as e, m from hosts where m <> ''),
parts as (select rid, s, e from keys union all select rid, s, e from base where kind = 0),
ends as (select * from addresses w where exists (select 1 from ids p where p.rid = w.rid and {_CLOSE}) and exists (select 1 from parts p where p.rid = w.rid and {_CLOSE})),
linked as (select * from keys union all select * from ends),
b as (select rid, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, {_JOINED} as x from base group by rid),
w as (select rid, count(*) filter (kind > 2) as n, {_JOINED} as x from (select * from base union all select * from linked) group by rid)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(b.x, '')) as base_sha256, coalesce(w.x, '') as spans, coalesce(w.n, 0) as n_linked
from d left join b using (rid) left join w using (rid)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an expression, bit by bit: a byte comes in, and at each of eight marks the register moves on."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint"
    steps = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"


TRIE = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, conv_id - conv_id % 20 as base, {_crc32("conv_id::varchar")} % 4 as h, list({{'role': role, 'text': text}} order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as turns from t group by conv_id),
r as (select o.conv_id, list_concat(coalesce(b.turns[1 : o.h], []), o.turns[o.h + 1 :]) as turns from o left join o b on b.conv_id = o.base),
p as (select conv_id, len(turns) as size, unnest(range(len(turns) + 1)) as depth, turns from r),
k as (select conv_id, size, depth, md5(turns[1 : depth]::varchar) || depth as node, case when depth > 0 then md5(turns[1 : depth - 1]::varchar) || (depth - 1) end as parent, case when depth > 0 then len({_SPACED.format(x="turns[depth].text")}) else 0 end as words from p),
n as (select node, any_value(depth) as depth, any_value(parent) as parent, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth), '')) as ends_sha256 from k group by node),
c as (select parent as node, count(*) as n_children from n where parent is not null group by parent),
s as (select a.node, sum((n.n_convs - 1) * n.words) as saved, count(*) filter (c.node is null) as leaves from n left join c using (node) join k a on a.conv_id = n.conv_id and a.depth <= n.depth group by a.node)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from n join s using (node) left join c using (node) left join n up on up.node = n.parent"""

_LETTERS = r"regexp_extract_all({x}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')"

VARIANTS = rf"""
with runs as (select coalesce(doc_id::varchar, '') as doc, translate(unnest({_LETTERS.format(x="coalesce(text, '')")}), '{_UPPER}', '{_UPPER.lower()}') as run from documents),
once as (select doc, run, count(*) as n from runs where length(run) >= 5 group by doc, run),
h as (select run, n, {_crc32("doc || ':' || run")} as h from once),
w as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
v as (select word, cast(sum(n) as bigint) as n from w where length(word) >= 5 group by word having sum(n) >= 3),
open as (select word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) as k from (select word, n, unnest(range(length(word))) as i from v)),
cut as (select distinct word, n, substr(word, 1, i) || substr(word, i + 2) as k from open),
pairs as (select a.word, b.word as other, b.n as other_n from open a join open b on a.k = b.k and a.word <> b.word
  union all select cut.word, v.word, v.n from cut join v on v.word = cut.k union all select v.word, cut.word, cut.n from cut join v on v.word = cut.k),
near as (select word, count(*) as n_near, max(other_n) as best_n, arg_min(other, (-other_n, other)) as best from pairs group by word),
f as (select v.word, v.n, coalesce(near.n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from v left join near using (word)),
chain as (with recursive c as (select word, word as root, form from f union all select c.word, f.word, f.form from c join f on f.word = c.form) select word, root from c where form is null)
select f.word, f.form, chain.root, f.n, f.n_near, f.form_n from f join chain using (word)"""

SQL = {"op5_secret_scan": SECRETS, "op1_line_dedup": LINES, "op8_repeated_phrases": PHRASES, "op10_decontaminate": DECONTAMINATE, "op12_prefix_trie": TRIE, "op13_spelling_variants": VARIANTS}
