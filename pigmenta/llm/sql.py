"""DuckDB SQL of the queries that SQL can express, over whole tables.

The mix is drawn by hashes, quality needs a tokeniser, the language model a trie, and the
scans look around their matches, which this dialect's expressions cannot: those queries
are tested against brute force instead.
"""

from __future__ import annotations

from .sharding import SHARDS, SLOTS, lookup_table

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sharding_sql() -> str:
    table = ", ".join(str(s) for s in lookup_table(SHARDS, SLOTS))
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""with s as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {SLOTS})::int as slot from documents)
select doc_id, slot, ([{names}])[([{table}])[slot + 1] + 1] as shard from s"""


OP4 = f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
w as (select doc_id, k, array_to_string(ws[k + 1 : k + 50], ' ') as win from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as k from d)),
f as (select win, min(doc_id) as first from w group by 1),
gone as (select distinct w.doc_id, w.k + unnest(range(0, 50)) as i from w join f using (win) where f.first < w.doc_id),
g as (select doc_id, list(i) as gs from gone group by 1),
each as (select d.doc_id, ws, coalesce(gs, []) as gs from d left join g using (doc_id))
select doc_id, len(ws) as n_words, len(gs) as n_removed,
  sha256(coalesce((select string_agg(ws[j + 1], ' ' order by j) from (select unnest(range(0, len(ws))) as j) where not list_contains(gs, j)), '')) as kept_sha256 from each"""

OP5 = f"""with recursive d as materialized (select doc_id, {_WORDS.format(_LOWER.format("text"))} as ws from documents),
s as materialized (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[k + 1 : k + 3], ' ') end as g
  from (select doc_id, ws, unnest(range(0, greatest(len(ws) - 2, (len(ws) > 0)::int))) as k from d)),
n as materialized (select d.doc_id, count(g) as n from d left join s using (doc_id) group by 1),
links as materialized (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
  join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  where 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on l.a = r.b)
select n.doc_id, n.n as n_shingles, min(reach.b) as component_id from n join reach on reach.a = n.doc_id group by 1, 2"""

OP9 = """with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
b as (select page_id, strlen(body) as n, h, max(page_id) over (partition by h) as last,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1) for i in range(0, 32)], '') as digest from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from b"""

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""with d as materialized (select doc_id, {_TERMS.format(_LOWER.format("text"))} as ws from documents),
i as (select item_id, {_TERMS.format(_LOWER.format("text"))} as ws from benchmark),
p as materialized (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k + 1 : k + least(len(ws), 10)], ' ') as win
  from (select item_id, ws, unnest(range(0, len(ws) - least(len(ws), 10) + (len(ws) > 0)::int)) as k from i)),
w as (select doc_id, n, k, array_to_string(ws[k + 1 : k + n], ' ') as win from (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) as k from d, (select distinct n from p))),
m as materialized (select w.doc_id, w.n, w.k, p.item_id from w join p on p.n = w.n and p.win = w.win),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, k + unnest(range(0, n)) as j from m) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from m) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join found using (doc_id)"""



def _crc_table() -> list[int]:
    """What CRC-32 (reflected polynomial 0xEDB88320) makes of each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {0}), lambda c, b: xor(c >> 8, ([" + ", ".join(str(x) for x in _crc_table()) + "])[(xor(c, b) & 255) + 1]::bigint)), 4294967295::bigint)"
#: Bytes of a text as a list of numbers.
_BYTES = "list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::bigint)"

OP11 = f"""with docs as materialized (select doc_id as id, false as target, {_TERMS.format(_LOWER.format("text"))} as ws from documents),
items as materialized (select row_number() over () as id, true as target, {_TERMS.format(_LOWER.format("text"))} as ws from benchmark),
f as materialized (select id, target, array_to_string(ws[k + 1 : k + n], ' ') as f, count(*) as c
  from (select id, target, ws, n, unnest(range(0, len(ws) - n + 1)) as k from (from docs union all from items), range(1, 4) r(n)) group by all),
d as materialized (select f, {_CRC.format(_BYTES.format("f"))} % 10000 as b, sum(c) filter (where not target) as s, sum(c) filter (where target) as t from f group by 1),
g as materialized (select b, coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from d group by 1),
gain as materialized (select b, floor(1000 * ln((t + 1)::double * ((select sum(s) from g) + 10000)::double / ((s + 1)::double * ((select sum(t) from g) + 10000)::double)))::bigint as gain from g),
w as (select id, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from f join d using (f) join gain using (b) where not target group by 1),
h as (select id as doc_id, len(ws) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('42:' || id), 1, 8))::bigint as h from docs left join w using (id)),
s as (select doc_id, n, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from s where n >= 20 qualify rank <= 5 * count(*) over () // 100)
select doc_id, n_features, weight, score, rank from s left join r using (doc_id)"""


def _leaf(text: str) -> str:
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes ``name(tree, lvl, pos, n, digest)`` over ``leaves(tree, pos, n, digest)``, and ``name_sides`` with what is beside each."""
    beside = "coalesce(string_agg(digest, '') over (partition by tree, lvl, pos // 8 order by pos rows between {0}), '')"
    return f"""{name}(tree, lvl, pos, n, digest) as (
  select tree, 0, pos, n, digest from {leaves}
  union all
  select tree, any_value(lvl) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by tree, pos // 8),
{name}_sides as materialized (select tree, lvl, pos, {{'l': {beside.format("unbounded preceding and 1 preceding")}, 'r': {beside.format("1 following and unbounded following")}}} as side from {name} where n > 1)"""


def _path(name: str) -> str:
    """Of each leaf: (tree, pos, sides)."""
    return f"select a.tree, a.pos, coalesce(list(s.side order by s.lvl) filter (where s.side is not null), []) as sides from {name} a left join {name}_sides s on s.tree = a.tree and s.pos = a.pos // (8 ** s.lvl)::bigint where a.lvl = 0 group by 1, 2"


OP12 = f"""with recursive d as materialized (select doc_id, coalesce('=' || lang, '') as tree, {_leaf("text")} as leaf,
  case when {_CRC.format("list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)")} % 3 = 0
    then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other from documents),
l as materialized (select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as pos, count(*) over (partition by tree) as n, leaf as digest from d),
{_tree("t", "l")},
sub as materialized (select tree as lang, row_number() over (order by tree) - 1 as pos, count(*) over () as n, digest, '' as tree from t where n = 1),
{_tree("u", "sub")},
p as materialized ({_path("t")}),
q as materialized ({_path("u")}),
e as (select l.doc_id, l.leaf, l.other, sub.digest as subroot, (select digest from u where n = 1) as root, list_concat(p.sides, q.sides) as sides
  from l join p using (tree, pos) join sub on sub.lang = l.tree join q on q.pos = sub.pos),
o as (select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.l || s.r), '')) as proof_sha256,
  list_reduce(list_prepend(coalesce(other, leaf), list_transform(sides, lambda s: s.l || ' ' || s.r)), lambda a, s: sha256(split_part(s, ' ', 1) || a || split_part(s, ' ', 2))) as folded_root from e)
select *, folded_root = root as verified from o"""

SQL = {"op3_sharding": sharding_sql(), "op4_substring_dedup": OP4, "op5_ngram_jaccard": OP5, "op9_warc": OP9, "op10_decontamination": OP10, "op11_importance": OP11, "op12_merkle": OP12}
