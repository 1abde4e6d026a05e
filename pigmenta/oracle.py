"""DuckDB SQL for the deterministic graph queries, written apart from the DataFrame code."""

from __future__ import annotations

from .functions import HASH_MULTIPLIER, LARGE_DEGREE

G1_PAIRS = """select least(x.l_partkey, y.l_partkey) a, greatest(x.l_partkey, y.l_partkey) b
  from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_linenumber + 1 = y.l_linenumber
  where x.l_partkey <> y.l_partkey"""
G2_PAIRS = """select x.l_partkey a, y.l_partkey b
  from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey"""
G3_PAIRS = """select least(2 * o_custkey, 2 * l_partkey + 1) a, greatest(2 * o_custkey, 2 * l_partkey + 1) b
  from lineitem join orders on l_orderkey = o_orderkey"""
G4_PAIRS = """select least(a, b) a, greatest(a, b) b from (
    select l_orderkey a, lead(l_orderkey) over (partition by l_partkey, l_suppkey order by l_shipdate, l_orderkey) b from lineitem)
  where b is not null and a <> b"""
PAIRS = {"g1": G1_PAIRS, "g2": G2_PAIRS, "g3": G3_PAIRS, "g4": G4_PAIRS}


def graph(name: str) -> str:
    """Common tables ``edges(src, dst)`` and ``deg(v, d)``."""
    return f"""und as materialized (select distinct a, b from ({PAIRS[name]})),
edges as materialized (select a src, b dst from und union all select b, a from und),
deg as materialized (select src v, count(*) d from edges group by 1)"""


_X = f"(xor({{0}} >> 16, {{0}}) * {HASH_MULTIPLIER}) & 4294967295"


def hashed(source: str, keep: str, of: str) -> str:
    """A query: the columns ``keep`` of ``source`` and the hash ``h`` of ``of``."""
    return f"select {keep}, xor(h2 >> 16, h2) h from (select *, {_X.format('h1')} h2 from (select *, {_X.format(of)} h1 from {source}))"


HASHED = f"deg_h as materialized ({hashed('deg', 'v, d', 'v')})"


def peel(rule: str, theta: int) -> str:
    """Recursive table ``p`` and ``peeled(v, rnd, rdeg, theta, pri)``, after ``graph``."""
    first = {"sl_els": "1", "sl_els_sdc": "1", "rgp": "1", "jp_sl": "min(d) over ()", "cpu_sl": "min(d) over ()", "jp_adg": "floor(avg(d) over ())", "cpu_adg": "avg(d) over ()", "jp_sll": "1", "cpu_sll": "1"}[rule]
    left = "s.deg - coalesce(x.c, 0)"
    power = 1 + theta if rule == "jp_sll" else 1
    then = {
        "sl_els": "min(s.deg) over ()",
        "sl_els_sdc": f"min({left}) over ()",
        "rgp": f"min({left}) over ()",
        "jp_sl": f"min({left}) over ()",
        "cpu_sl": f"min({left}) over ()",
        "jp_adg": f"floor(avg({left}) over ())",
        "cpu_adg": f"avg({left}) over ()",
        "jp_sll": f"pow(2, least((s.rnd + 1) * {power}, 62))",
        "cpu_sll": "pow(2, least(s.rnd + 1, 62))",
    }[rule]
    margin = theta if rule in ("sl_els", "sl_els_sdc", "rgp", "jp_sl", "jp_sll") else 0
    pri = {"jp_sll": "rnd", "jp_adg": "0", "rgp": f"(rnd + 1) * {margin + 1}"}.get(rule, f"rnd * {margin + 1} + (rdeg - cast(floor(theta) as bigint)) + 1")
    return f"""p(v, deg, rnd, theta) as (
  select v, d::bigint, 0, ({first})::double from deg
  union all
  select s.v, {left}, s.rnd + 1, ({then})::double
  from (select * from p where deg > theta + {margin}) s
  left join (select e.dst v, count(*) c from p r join edges e on e.src = r.v where r.deg <= r.theta + {margin} group by 1) x on x.v = s.v),
last as materialized (select v, max(rnd) rnd, arg_max(deg, rnd) rdeg, arg_max(theta, rnd) theta from p group by v),
peeled as materialized (select v, rnd, rdeg, theta, cast({pri} as bigint) pri from last)"""


ORDERS = {
    "device": f"(d >= {LARGE_DEGREE})::int desc, pri desc, d desc, h desc, v desc",
    "cpu": f"(d >= {LARGE_DEGREE})::int desc, rnd desc, rdeg desc, case when h >= 2147483648 then h - 4294967296 else h end desc, v desc",
    "large_degree": f"(d >= {LARGE_DEGREE})::int desc, d desc, h desc, v desc",
    "degree": "d desc, h desc, v desc",
    "degree_id": "d desc, v asc",
    "natural": "v asc",
    "smallest_last": "pri desc",
}


def first_fit(order: str, peeled: bool) -> str:
    """Tables up to ``k(v, color)``: first fit in the order, after ``graph`` and ``HASHED``."""
    source = "deg_h join peeled using (v)" if peeled else "deg_h"
    return f"""prio as materialized (select v, row_number() over (order by {ORDERS[order]}) rk from {source}),
dag as materialized (select e.src v, e.dst u from edges e join prio a on a.v = e.src join prio b on b.v = e.dst where b.rk < a.rk),
ind as materialized (select p.v, count(u) n from prio p left join dag using (v) group by 1),
k(v, color) using key (v) as (
  select v, 0::bigint from ind where n = 0
  union
  select r.v, (select min(g) from range(0, len(r.cs) + 1) t(g) where not list_contains(r.cs, g))
  from (select dag.v, list(distinct q.color) cs, count(*) n from dag join recurring.k q on q.v = dag.u
        where not exists (select 1 from recurring.k z where z.v = dag.v) group by 1) r
  join ind on ind.v = r.v and ind.n = r.n)"""


#: Smallest free number of a list ``cs``.
MEX = "(select min(g) from range(0, len(cs) + 1) t(g) where not list_contains(cs, g))"

#: Removal by least (degree, id), one vertex a step; ``peeled.pri`` is the index of removal.
SMALLEST_LAST = """sl(v, deg, i) as (
  select v, d::bigint, 0 from deg
  union all
  select s.v, s.deg - (e.src is not null)::bigint, s.i + 1
  from (select *, first(v) over (order by deg, v) gone from sl) s left join edges e on e.src = s.gone and e.dst = s.v where s.v <> s.gone),
peeled as materialized (select v, max(i) + 1 pri from sl group by v)"""


def smallest_last_of(name: str) -> str:
    return f"with recursive {graph(name)}, {HASHED}, {SMALLEST_LAST}, {first_fit('smallest_last', True)} select v as id, color::int as color from k"


def saturation_of(name: str) -> str:
    """One vertex a step: most distinct colours beside it, then degree, then lowest id."""
    return f"""with recursive {graph(name)},
k(v, color) using key (v) as (
  (select v, 0::bigint from deg order by d desc, v limit 1)
  union
  (select v, {MEX} from (
    select e.src v, coalesce(list(distinct q.color) filter (where q.color is not null), []) cs, any_value(g.d) d
    from edges e join deg g on g.v = e.src left join recurring.k q on q.v = e.dst
    where e.src not in (select v from recurring.k) group by 1 order by len(cs) desc, d desc, v limit 1)))
select v as id, color::int as color from k"""


def speculative_of(name: str) -> str:
    """All try the first free colour; of two alike, the later one in the order tries again."""
    tried = f"""(select v, {MEX} c from (select p.v, coalesce(list(distinct q.color) filter (where q.color is not null), []) cs
      from prio p join edges e on e.src = p.v left join recurring.k q on q.v = e.dst
      where p.v not in (select v from recurring.k) group by 1))"""
    return f"""with recursive {graph(name)}, {HASHED},
prio as materialized (select v, row_number() over (order by {ORDERS["large_degree"]}) rk from deg_h),
dag as materialized (select e.src v, e.dst u from edges e join prio a on a.v = e.src join prio b on b.v = e.dst where b.rk < a.rk),
k(v, color) using key (v) as (
  select v, 0::bigint from prio where v not in (select v from dag)
  union
  select a.v, a.c from {tried} a where not exists (select 1 from dag join {tried} b on b.v = dag.u where dag.v = a.v and b.c = a.c))
select v as id, color::int as color from k"""


def greedy_partition_of(name: str, parts: int) -> str:
    """One vertex a step, in id order."""
    return f"""with recursive {graph(name)},
ids as materialized (select v, row_number() over (order by v) i from deg),
e as materialized (select a.i s, b.i d from edges join ids a on a.v = src join ids b on b.v = dst),
size as materialized (select ceil(count(*) / {parts})::bigint room from deg),
k(i, part) using key (i) as (
  select 1::bigint, 0::bigint
  union
  select i, case when arg_min(c, ord) >= any_value(room) then arg_min(p, c * {parts} + p) else arg_min(p, ord) end
  from (select next.i, t.p, coalesce(n.c, 0) c, size.room,
      {{'a': -round(coalesce(b.c, 0) - least(coalesce(n.c, 0) / size.room, 1.0), 9), 'b': coalesce(n.c, 0), 'c': t.p}} ord
    from (select max(i) + 1 i from recurring.k) next, range({parts}) t(p), size
    left join (select part, count(*) c from recurring.k group by 1) n on n.part = t.p
    left join (select q.part, count(*) c from e join recurring.k q on q.i = e.d where e.s = (select max(i) + 1 from recurring.k) group by 1) b on b.part = t.p
    where next.i <= (select count(*) from ids)) group by i)
select v as id, part::int as part from ids join k using (i)"""


def parted(name: str, parts: int, theta: int) -> str:
    """Tables for round-robin parts: ``bk(v, color)`` of the boundary and ``ik(v, color)`` of the others.

    The boundary is coloured within the graph it induces; each part's own vertices then in
    the order of the part with copies of the whole boundary.
    """
    def peeled(table: str, prefix: str, by: str) -> str:
        keys, over = ("part, v", "(partition by part)") if by else ("v", "()")
        s_keys, on = ("s.part, s.v", "x.v = s.v and x.part = s.part") if by else ("s.v", "x.v = s.v")
        lost = f"select {'e.part, ' if by else ''}e.dst v, count(*) c from {prefix}p r join {prefix}e e on e.src = r.v {'and e.part = r.part' if by else ''} where r.deg <= r.theta + {theta} group by all"
        return f"""{prefix}p({keys}, deg, rnd, theta) as (
  select {keys}, d::bigint, 0, 1::bigint from {table}
  union all
  select {s_keys}, s.deg - coalesce(x.c, 0), s.rnd + 1, min(s.deg - coalesce(x.c, 0)) over {over.replace("part)", "s.part)")}
  from (select * from {prefix}p where deg > theta + {theta}) s left join ({lost}) x on {on})"""

    order = f"(d >= {LARGE_DEGREE})::int desc, rnd desc, h desc, local desc"
    return f"""{graph(name)},
part as materialized (select v, (v % {parts})::int part from deg),
cut as materialized (select e.src v from edges e where e.src % {parts} <> e.dst % {parts}),
edge as materialized (select distinct v from cut),
be as materialized (select src, dst from edges where src in (select v from edge) and dst in (select v from edge)),
bd as materialized (select v, (select count(*) from be where src = v) d, row_number() over (order by v) - 1 local from edge),
{peeled("bd", "b", "")},
br as materialized (select v, row_number() over (order by {order}) rk from (select bd.v, d, rnd, h, local from ({hashed("bd", "v, d, local", "local")}) bd join (select v, max(rnd) rnd from bp group by 1) using (v))),
bdag as materialized (select e.src v, e.dst u from be e join br a on a.v = e.src join br b on b.v = e.dst where b.rk < a.rk),
bn as materialized (select br.v, count(u) n from br left join bdag using (v) group by 1),
bk(v, color) using key (v) as (
  select v, 0::bigint from bn where n = 0
  union
  select v, {MEX} from (select bdag.v, list(distinct q.color) cs, count(*) m from bdag join recurring.bk q on q.v = bdag.u where bdag.v not in (select v from recurring.bk) group by 1) join bn using (v) where m = n),
mem as materialized (select part, v, row_number() over (partition by part order by own desc, v) - 1 local, own from (
  select part, v, true own from part union all select t.p::int, v, false from edge join part using (v), range({parts}) t(p) where t.p <> part)),
se as materialized (select a.part, e.src, e.dst from edges e join mem a on a.v = e.src join mem b on b.v = e.dst and b.part = a.part),
sd as materialized (select part, v, local, own, coalesce(c, 0) d from mem left join (select part, src v, count(*) c from se group by all) using (part, v)),
{peeled("sd", "s", "part")},
ir as materialized (select v, row_number() over (order by {order}) rk from (select sd.v, d, rnd, h, local from ({hashed("sd", "part, v, d, local, own", "local")}) sd
  join (select part, v, max(rnd) rnd from sp group by all) using (part, v) where own and v not in (select v from edge))),
idag as materialized (select e.src v, e.dst u from edges e join ir a on a.v = e.src join ir b on b.v = e.dst where b.rk < a.rk),
fixed as materialized (select ir.v, coalesce(list(distinct color) filter (where color is not null), []) fs from ir left join edges e on e.src = ir.v left join bk q on q.v = e.dst group by 1),
inn as materialized (select fixed.v, fs, count(u) n from fixed left join idag using (v) group by all),
ik(v, color) using key (v) as (
  select v, {MEX} from (select v, fs cs from inn where n = 0)
  union
  select v, {MEX} from (select v, list_distinct(list_concat(cs, fs)) cs from (
    select idag.v, list(distinct q.color) cs, count(*) m from idag join recurring.ik q on q.v = idag.u where idag.v not in (select v from recurring.ik) group by 1) join inn using (v) where m = n))"""


def boundary_colors_of(name: str, parts: int, theta: int) -> str:
    return f"with recursive {parted(name, parts, theta)} select v as id, color::int as color from bk"


def part_colors_of(name: str, parts: int, theta: int) -> str:
    return f"with recursive {parted(name, parts, theta)} select v as id, color::int as color from bk union all select v, color::int from ik"


def edges_of(name: str) -> str:
    return f"with {graph(name)} select src, dst from edges"


def peel_of(name: str, rule: str, theta: int) -> str:
    return f"with recursive {graph(name)}, {peel(rule, theta)} select v as id, rnd::int as round, rdeg, theta, pri from peeled"


def color_of(name: str, order: str, rule: str | None = None, theta: int = 0, select: str = "select v as id, color::int as color from k") -> str:
    peeled = f"{peel(rule, theta)}," if rule else ""
    return f"with recursive {graph(name)}, {HASHED}, {peeled} {first_fit(order, rule is not None)} {select}"


def summary_of(name: str) -> str:
    """What ``verify`` says of any proper colouring, without the number of colours."""
    return f"with {graph(name)} select count(*) as n_vertices, 0::bigint as uncolored, 0::bigint as conflicts from deg"
