"""Graph queries over the successor graph of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamic as d
from ..operators import graph as g
from .adapters import EDGES, ENTITIES, edges, entities, read
from .iterate import Budget, write_round

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


STEPS = f"with recursive {EDGES}, steps as (select distinct src, dst from edges where src <> dst)"

def _one(spark, key, extra=0):
    return spark.createDataFrame([(extra, key)], "source long, node long")


@query("graph_callers", f"with {EDGES} select src as caller, min(line)::int as first_line, count(*) as calls from edges where dst = 1 group by src")
def callers(spark, sf):
    target = entities(spark, sf).where("id = 1").select("id")
    return g.callers(edges(spark, sf), target).groupBy(F.col("src").alias("caller")).agg(F.min("line").alias("first_line"), F.count("*").alias("calls"))


@query("graph_callees", f"with {EDGES} select dst as callee, min(line)::int as first_line, count(*) as calls from edges where src = 1 group by dst")
def callees(spark, sf):
    source = entities(spark, sf).where("id = 1").select("id")
    return g.callees(edges(spark, sf), source).groupBy(F.col("dst").alias("callee")).agg(F.min("line").alias("first_line"), F.count("*").alias("calls"))


@query("graph_resolve_name", f"""with {ENTITIES}, q(n) as (values ((select min(qualified) from entities)), ((select min(name) from entities)))
    select distinct e.id from entities e, q where (e.qualified = q.n) or (e.name = q.n and not exists (select 1 from entities x where x.qualified = q.n))""")
def resolve(spark, sf):
    e = entities(spark, sf)
    names = e.agg(F.min("qualified"), F.min("name")).first()  # two names to ask for
    return g.resolve_name(e, names[0]).union(g.resolve_name(e, names[1])).distinct()


@query("graph_top_callers", f"""with {EDGES} select dst as node, count(distinct src) as callers, count(*) as calls from edges group by dst
    order by callers desc, calls desc, node limit 20""")
def top_callers(spark, sf):
    return edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers"), F.count("*").alias("calls")).orderBy(F.desc("callers"), F.desc("calls"), "node").limit(20)


@query("fn_fan_in_out", f"""with {EDGES}, i as (select dst as node, count(distinct src) as fan_in from edges group by dst),
    o as (select src as node, count(distinct dst) as fan_out from edges group by src)
    select node, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out, coalesce(fan_in, 0) + coalesce(fan_out, 0) as total
    from i full join o using (node) order by total desc, node limit 30""")
def fan(spark, sf):
    d = g.degrees(edges(spark, sf)).withColumn("total", F.col("fan_in") + F.col("fan_out"))
    return d.select("node", "fan_in", "fan_out", "total").orderBy(F.desc("total"), "node").limit(30)


@query("graph_orphans", f"with {EDGES}, first as (select src, min(dst) as dst from edges where src <> dst group by src) select p_partkey as id from part where p_partkey not in (select dst from first)")
def orphans(spark, sf):
    """Of each part's successors the first one counts: with all of them no part is without a caller."""
    first = edges(spark, sf).where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    return g.orphans(entities(spark, sf).select("id"), first)


def _reach_sql(a, b, depth, seeds="select 1::bigint, 1::bigint, 0", table="steps"):
    return f"""{STEPS}, walk(source, node, depth) as ({seeds} union select w.source, s.{b}, w.depth + 1 from walk w join {table} s on s.{a} = w.node where w.depth < {depth})"""


@query("graph_bfs_down", _reach_sql("src", "dst", 3) + " select node, min(depth)::int as depth from walk group by node")
def bfs_down(spark, sf):
    return g.reach(edges(spark, sf), _one(spark, 1), 3).select("node", "depth")


@query("graph_bfs_up", _reach_sql("dst", "src", 2) + " select node, min(depth)::int as depth from walk group by node")
def bfs_up(spark, sf):
    return g.reach(edges(spark, sf), _one(spark, 1), 2, up=True).select("node", "depth")


@query("graph_blast_multi", _reach_sql("dst", "src", 2, "select p_partkey, p_partkey, 0 from part")
       + " select source, depth, count(*) as n from (select source, node, min(depth)::int as depth from walk group by source, node) group by source, depth")
def blast_multi(spark, sf):
    seeds = read(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("node"))
    return g.reach_counts(edges(spark, sf), seeds, 2, up=True)


@query("graph_frontier", f"""{STEPS}, up(node, depth) as (select id, 0 from (values (1::bigint), (2)) t(id) union select s.src, depth + 1 from up join steps s on s.dst = node where depth < 2),
    down(node, depth) as (select id, 0 from (values (1::bigint), (2)) t(id) union select s.dst, depth + 1 from down join steps s on s.src = node where depth < 2),
    roles as (select node, case when min(depth) = 1 then 1 else 3 end as r from up group by node having min(depth) > 0
        union all select node, case when min(depth) = 1 then 2 else 4 end from down group by node having min(depth) > 0)
    select node, ['direct_caller', 'direct_callee', 'upstream', 'downstream'][min(r)] as role from roles group by node""")
def frontier(spark, sf):
    return g.frontier(edges(spark, sf), spark.createDataFrame([(1,), (2,)], "id long"), 2)


@query("graph_vulnerability", _reach_sql("dst", "src", 2, "select event_id, event_id % (select count(*) from part), 0 from events where event_type = 'error'")
       + " select node, count(distinct source) as n_findings from walk group by node having count(distinct source) >= 2 order by n_findings desc, node limit 20")
def vulnerability(spark, sf):
    return _vulnerability(spark, sf, read(spark, sf, "events").where("event_type = 'error'"))


def _vulnerability(spark, sf, events):
    n = read(spark, sf, "part").count()
    found = events.select(F.col("event_id").alias("id"), (F.col("event_id") % n).alias("node"))
    return g.vulnerability(edges(spark, sf), found, 2)


@query("graph_test_impact", _reach_sql("dst", "src", 60, "select 0, p_partkey, 0 from part where p_partkey % 50 = 49", "dag").replace("walk(source", "dag as (select * from steps where src < dst), walk(source")
       + " select distinct node, p_name as name from walk join part on p_partkey = node where node % 2 = 1 and node % 50 <> 49")
def test_impact(spark, sf):
    return _test_impact(spark, sf, edges(spark, sf).where("src < dst"))


def _test_impact(spark, sf, dag):
    seeds = read(spark, sf, "part").where("p_partkey % 50 = 49").select(F.lit(0).cast("long").alias("source"), F.col("p_partkey").alias("node"))
    hit = g.reach(dag, seeds, None, up=True).where("depth > 0 and node % 2 = 1")
    return hit.join(entities(spark, sf).select(F.col("id").alias("node"), "name"), "node").select("node", "name")


@query("graph_clone_impact", _reach_sql("dst", "src", 1, "select 0, p_partkey, 0 from part where (p_brand, p_type, p_size) in (select (p_brand, p_type, p_size) from part where p_partkey = 1)")
       + " select node, min(depth)::int as depth from walk group by node")
def clone_impact(spark, sf):
    part = read(spark, sf, "part")
    like = part.where("p_partkey = 1").select("p_brand", "p_type", "p_size")
    seeds = part.join(like, ["p_brand", "p_type", "p_size"], "left_semi").select(F.lit(0).cast("long").alias("source"), F.col("p_partkey").alias("node"))
    return g.reach(edges(spark, sf), seeds, 1, up=True).select("node", "depth")


LAYER_EDGES = "dag as (select distinct src, dst from edges where src < dst)"


@query("graph_layers", f"""with recursive {EDGES}, {LAYER_EDGES}, walk(node, layer) as (select p_partkey, 0 from part
    union select d.src, w.layer + 1 from walk w join dag d on d.dst = w.node) select node, max(layer)::int as layer from walk group by node""")
def layers(spark, sf):
    return g.layers(entities(spark, sf).select("id"), edges(spark, sf).where("src < dst"))


@query("graph_depth_histogram", f"""with recursive {EDGES}, {LAYER_EDGES}, walk(node, layer) as (select p_partkey, 0 from part
    union select d.src, w.layer + 1 from walk w join dag d on d.dst = w.node)
    select layer, count(*) as n from (select node, max(layer)::int as layer from walk group by node) group by layer""")
def depth_histogram(spark, sf):
    return layers(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


@query("graph_topological", f"""with recursive {EDGES}, {LAYER_EDGES}, walk(node, layer) as (select p_partkey, 0 from part
    union select d.src, w.layer + 1 from walk w join dag d on d.dst = w.node)
    select node, max(layer)::int as layer from walk group by node order by layer desc, node limit 100""")
def topological(spark, sf):
    return layers(spark, sf).orderBy(F.desc("layer"), "node").limit(100)


@query("graph_cycles", f"""with {EDGES}, s as (select distinct src, dst from edges where src <> dst)
    select [a.src, a.dst] as cycle from s a join s b on a.dst = b.src and b.dst = a.src where a.src < a.dst
    union all select [a.src, a.dst, b.dst] from s a join s b on a.dst = b.src join s c on c.src = b.dst and c.dst = a.src
    where a.src < a.dst and a.src < b.dst and a.dst <> b.dst""")
def cycles(spark, sf):
    return g.cycles(edges(spark, sf), 3)


#: Of each part's successors the first and the last: a sparse graph, in which cycles are few and long.
SPARSE = f"{EDGES}, s as (select src, min(dst) as dst from edges where src <> dst group by src union select src, max(dst) from edges where src <> dst group by src)"


@query("graph_cycles_deep", f"""with recursive {SPARSE}, walk(path) as (select [src, dst] from s where dst > src
    union all select list_append(path, dst) from walk join s on s.src = path[-1] where len(path) < 10 and dst > path[1] and not list_contains(path, dst)),
    c as (select path as cycle from walk join s on s.src = path[-1] and s.dst = path[1])
    select cycle, (select count(*) > 50 from c) as partial from c order by len(cycle), cycle limit 50""")
def cycles_deep(spark, sf):
    """The first 50 cycles of up to ten nodes."""
    ends = edges(spark, sf).where("src <> dst").groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    return g.cycles(ends.select("src", F.explode(F.array("a", "b")).alias("dst")), 10, most=50)


@query("graph_shortest_cycle", f"""with recursive {STEPS.removeprefix("with recursive ")}, walk(start, node, n) as (select src, dst, 1 from steps
    union select w.start, s.dst, w.n + 1 from walk w join steps s on s.src = w.node where w.start <> w.node and w.n < 4)
    select min(n)::int as length from walk where start = node having min(n) is not null""")
def shortest_cycle(spark, sf):
    return g.shortest_cycle(edges(spark, sf).where("src <> dst"))


@query("graph_shortest_cycle_path", f"""with {EDGES}, s as (select distinct src, dst from edges where src <> dst),
    c as (select 2 as l, a.src as x, a.dst as y, null::bigint as z from s a join s b on a.dst = b.src and b.dst = a.src
        union all select 3, a.src, b.src, c.src from s a join s b on a.dst = b.src join s c on b.dst = c.src and c.dst = a.src)
    select case when l = 2 then [x, y] else [x, y, z] end as cycle from c order by l, x, z, y limit 1""")
def shortest_cycle_path(spark, sf):
    return g.shortest_cycle_path(edges(spark, sf).where("src <> dst"))


@query("graph_strong_components", f"""{STEPS}, r(a, b) as (select src, dst from steps union select a, dst from r join steps on src = b)
    select x.a as node, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a having count(*) > 1""")
def strong_components(spark, sf):
    return g.strong_components(edges(spark, sf)).select("node", "component")


NAMED = f"with recursive {EDGES}, {ENTITIES}, steps as (select distinct a.qualified as src, b.qualified as dst from edges join entities a on a.id = src join entities b on b.id = dst where src <> dst)"


@query("graph_chain_names", NAMED + """, walk(node, depth) as (select qualified, 0 from entities where id = 1 union select s.dst, depth + 1 from walk join steps s on s.src = node where depth < 2),
    least as (select node, min(depth)::int as depth from walk group by node)
    select a.node, min(b.node) as via, a.depth from least a join steps s on s.dst = a.node join least b on b.node = s.src and b.depth = a.depth - 1 where a.depth > 0 group by a.node, a.depth""")
def chain_names(spark, sf):
    e = entities(spark, sf).select("id", "qualified")
    named = edges(spark, sf).join(e.select(F.col("id").alias("src"), F.col("qualified").alias("a")), "src").join(e.select(F.col("id").alias("dst"), F.col("qualified").alias("b")), "dst")
    start = e.where("id = 1").select(F.col("qualified").alias("source"), F.col("qualified").alias("node"))
    return g.chain(named.select(F.col("a").alias("src"), F.col("b").alias("dst")), start, 2).select("node", "via", "depth")


@query("graph_chain_levels", _reach_sql("dst", "src", 2, "select p_partkey, p_partkey, 0 from part") + """, least as (select source, node, min(depth)::int as depth from walk group by all having min(depth) > 0)
    select source, depth, count(*) as n, sum(count(*)) over (partition by source)::bigint as total from least group by source, depth""")
def chain_levels(spark, sf):
    starts = read(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("node"))
    return g.with_totals(g.reach_counts(edges(spark, sf), starts, 2, up=True).where("depth > 0"))


@query("graph_budget", _reach_sql("src", "dst", 2) + """, least as (select node, min(depth)::int as depth from walk group by node)
    select node, depth, (select count(*) > 100 or max(depth) = 2 from least) as partial from least order by depth, node limit 100""")
def budgeted(spark, sf):
    limits = Budget(depth=2)
    found = g.reach(edges(spark, sf), _one(spark, 1), None, budget=limits)
    return limits.cut(found.select("node", "depth"), "depth", "node")


@query("mod_edges", f"""with {EDGES} select a.p_brand as src_module, b.p_brand as dst_module, count(*) as calls, count(distinct src) as callers, count(distinct dst) as callees
    from edges join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_brand <> b.p_brand group by all""")
def module_edges(spark, sf):
    return g.module_graph(edges(spark, sf), entities(spark, sf).select("id", "module"))


@query("mod_segment", f"""with {ENTITIES} select split_part(qualified, '::', 1) || '::' || split_part(qualified, '::', 2) as module, count(*) as n from entities group by 1""")
def module_of_name(spark, sf):
    return entities(spark, sf).groupBy(F.substring_index("qualified", "::", 2).alias("module")).agg(F.count("*").alias("n"))


@query("mod_coupling", """with e as (select c_nationkey as a, s_nationkey as b, count(*) as n from orders join lineitem on l_orderkey = o_orderkey
    join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by all)
    select module, sum(i)::bigint as afferent, sum(o)::bigint as efferent, coalesce(round(sum(o) / nullif(sum(i) + sum(o), 0), 4), 0)::double as instability
    from (select a as module, 0 as i, n as o from e union all select b, n, 0 from e) group by module""")
def coupling(spark, sf):
    r = lambda n: read(spark, sf, n)
    lines = r("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    both = lines.join(r("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(r("customer").select("c_custkey", F.col("c_nationkey").alias("src_module")), "c_custkey")
    both = both.join(r("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst_module")), "s_suppkey").where("src_module <> dst_module")
    return g.coupling(both.groupBy("src_module", "dst_module").agg(F.count("*").alias("calls")))


@query("graph_heatmap", f"""with {EDGES} select p_brand as module, count(*) as calls_in, count(distinct src) as callers, count(distinct dst) as callees
    from edges join part on p_partkey = dst group by p_brand""")
def heatmap(spark, sf):
    into = edges(spark, sf).join(entities(spark, sf).select(F.col("id").alias("dst"), "module"), "dst")
    return into.groupBy("module").agg(F.count("*").alias("calls_in"), F.countDistinct("src").alias("callers"), F.countDistinct("dst").alias("callees"))


@query("graph_merge_preview", _reach_sql("dst", "src", 1, "select 0, n.c_custkey % 50, 0 from (select c_custkey, c_acctbal from customer where c_custkey % 7 <> 0) n left join (select c_custkey from customer where c_custkey % 10 <> 0) o using (c_custkey) where o.c_custkey is null")
       + " select count(distinct node) as impacted, case when count(distinct node) > 20 then 'high' when count(distinct node) > 5 then 'medium' else 'low' end as risk from walk")
def merge_preview(spark, sf):
    cust = read(spark, sf, "customer")
    added = cust.where("c_custkey % 7 <> 0").join(cust.where("c_custkey % 10 <> 0").select("c_custkey"), "c_custkey", "left_anti")
    seeds = added.select(F.lit(0).cast("long").alias("source"), (F.col("c_custkey") % 50).alias("node"))
    n = F.countDistinct("node")
    return g.reach(edges(spark, sf), seeds, 1, up=True).agg(n.alias("impacted"), g.risk_of(n, 20, 5).alias("risk"))


@query("graph_cross_impact", """select target, count(distinct source) as sources, case when count(distinct source) > 3 then 'high' when count(distinct source) > 1 then 'medium' else 'low' end as risk
    from (select c_nationkey as source, s_nationkey as target from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey) group by target""")
def cross_impact(spark, sf):
    r = lambda n: read(spark, sf, n)
    both = r("lineitem").join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = F.countDistinct("c_nationkey")
    return both.where("c_nationkey <> s_nationkey").groupBy(F.col("s_nationkey").alias("target")).agg(n.alias("sources"), g.risk_of(n, 3, 1).alias("risk"))


@query("tree_descend", """with recursive n as (select p_partkey as child, p_partkey // 3 as parent from part where p_partkey > 0),
    t(ancestor, node, depth) as (select id, id, 0 from (values (0::bigint), (1), (2)) r(id) union all select ancestor, child, depth + 1 from t join n on parent = node)
    select ancestor, node, depth::int as depth from t""")
def tree(spark, sf):
    children = read(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    return g.descend(children, spark.createDataFrame([(0,), (1,), (2,)], "id long"))


@query("tree_rollup", """with recursive n as (select p_partkey as child, p_partkey // 3 as parent, p_size from part where p_partkey > 0),
    t(ancestor, node) as (select p_partkey, p_partkey from part union all select ancestor, child from t join n on parent = node)
    select ancestor, count(*) as total, count_if(p_size >= 25) as done, round(count_if(p_size >= 25)::double / count(*), 4) as progress from t join part on p_partkey = node group by ancestor""")
def tree_rollup(spark, sf):
    part = read(spark, sf, "part")
    parents = part.where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 3").alias("parent"))
    values = part.select(F.col("p_partkey").alias("node"), F.lit(1).cast("long").alias("total"), (F.col("p_size") >= 25).cast("long").alias("done"))
    sums = g.rollup(parents, values, "total", "done")
    return sums.select(F.col("node").alias("ancestor"), "total", "done", g.ratio(F.col("done"), F.col("total")).alias("progress"))


@query("symbol_detail", f"""with {EDGES}, o as (select src as id, array_to_string(list_sort(list_distinct(list(dst))), ',') as calls_out from edges group by src),
    i as (select dst as id, array_to_string(list_sort(list_distinct(list(src))), ',') as calls_in from edges group by dst),
    f as (select user_id % 6 as id, count(*) as n_findings from events where event_type = 'error' and value >= 33 group by 1)
    select p_partkey as id, p_name as name, coalesce(calls_out, '') as calls_out, coalesce(calls_in, '') as calls_in, coalesce(n_findings, 0) as n_findings
    from part left join o on o.id = p_partkey left join i on i.id = p_partkey left join f on f.id = p_partkey""")
def symbol_detail(spark, sf):
    return _symbol_detail(spark, sf, "true")


def _symbol_detail(spark, sf, asked):
    e = edges(spark, sf)
    listed = lambda at, other, name: e.withColumn("id", F.col(at)).where(asked).groupBy(F.col(at).alias("id")).agg(F.array_join(F.sort_array(F.collect_set(other)).cast("array<string>"), ",").alias(name))
    found = read(spark, sf, "events").where("event_type = 'error' and value >= 33").groupBy((F.col("user_id") % 6).alias("id")).agg(F.count("*").alias("n_findings"))
    rows = entities(spark, sf).where(asked).select("id", "name")
    for part in (listed("src", "dst", "calls_out"), listed("dst", "src", "calls_in"), found):
        rows = rows.join(part, "id", "left")
    return rows.select("id", "name", F.coalesce("calls_out", F.lit("")).alias("calls_out"), F.coalesce("calls_in", F.lit("")).alias("calls_in"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


@query("review_readiness", _reach_sql("dst", "src", 2) + """, hit as (select node, min(depth) as depth from walk group by node)
    select count(*) as impacted, count_if(depth = 1) as direct, count_if(p_size >= 25) as must_test, case when count(*) > 20 then 'high' when count(*) > 5 then 'medium' else 'low' end as risk
    from hit join part on p_partkey = node where depth > 0""")
def review(spark, sf):
    hit = g.reach(edges(spark, sf), _one(spark, 1), 2, up=True).where("depth > 0").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("node"))
    return hit.agg(F.count("*").alias("impacted"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("p_size") >= 25).alias("must_test"), g.risk_of(F.count("*"), 20, 5).alias("risk"))


@query("graph_layers_delta", f"""with recursive {EDGES}, a as (select distinct src, dst from edges where src < dst),
    b as (select * from a where src % 97 <> 5 union select p_partkey, p_partkey + 13 from part where p_partkey % 101 = 3 and p_partkey + 13 in (select p_partkey from part)),
    wa(node, layer) as (select p_partkey, 0 from part union select a.src, wa.layer + 1 from wa join a on a.dst = wa.node),
    wb(node, layer) as (select p_partkey, 0 from part union select b.src, wb.layer + 1 from wb join b on b.dst = wb.node),
    la as (select node, max(layer)::int as old_layer from wa group by node), lb as (select node, max(layer)::int as new_layer from wb group by node)
    select node, old_layer, new_layer from la join lb using (node) where old_layer <> new_layer""")
def layers_delta(spark, sf):
    """Layers corrected from those before a change of some edges, not computed anew."""
    ids = entities(spark, sf).select("id")
    old = write_round(edges(spark, sf).where("src < dst").select("src", "dst").distinct(), "old")
    more = ids.where("id % 101 = 3").select(F.col("id").alias("src"), (F.col("id") + 13).alias("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    new = old.where("src % 97 <> 5").unionByName(more).distinct()
    return d.layers_delta(new, *d.edge_changes(old, new), write_round(g.layers(ids, old), "layers"))


@query("context_edges", f"""with e as (select o_orderpriority as context, l_partkey as callee from lineitem join orders on o_orderkey = l_orderkey)
    select context, count(*) as edges, count_if(callee % 7 <> 0) as resolved, round(count_if(callee % 7 <> 0)::double / count(*), 4) as rate from e group by context""")
def context_edges(spark, sf):
    e = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("context")), "o_orderkey")
    ok = F.count_if(F.col("l_partkey") % 7 != 0)
    return e.groupBy("context").agg(F.count("*").alias("edges"), ok.alias("resolved"), g.ratio(ok, F.count("*")).alias("rate"))


@query("graph_local_delta", f"""with recursive {EDGES}, a as (select distinct src, dst from edges where src < dst), b as (select * from a where src % 3 <> 0),
    wa(node, layer) as (select p_partkey, 0 from part union select a.src, wa.layer + 1 from wa join a on a.dst = wa.node),
    wb(node, layer) as (select p_partkey, 0 from part union select b.src, wb.layer + 1 from wb join b on b.dst = wb.node),
    la as (select node, max(layer)::int as old_layer from wa group by node), lb as (select node, max(layer)::int as new_layer from wb group by node)
    select node, old_layer, new_layer from la join lb using (node) where old_layer <> new_layer""")
def local_delta(spark, sf):
    return _local_delta(spark, sf, edges(spark, sf).where("src < dst"))


def _local_delta(spark, sf, dag):
    ids = entities(spark, sf).select("id")
    old = g.layers(ids, dag).withColumnRenamed("layer", "old_layer")
    return old.join(g.layers(ids, dag.where("src % 3 <> 0")).withColumnRenamed("layer", "new_layer"), "node").where("old_layer <> new_layer").select("node", "old_layer", "new_layer")
