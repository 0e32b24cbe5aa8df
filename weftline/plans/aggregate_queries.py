"""Aggregations, scores and rankings over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import histograms as h
from ..operators import relational as r
from ..operators.graph import ratio, risk_of
from .adapters import COVERAGE, FINDINGS, coverage, findings, read

QUERIES, SQL = {}, {}
RATIO = "coalesce(round(({0})::double / nullif({1}, 0), {2}), 0)::double"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("stats_global", """select count(*) as total, count_if(l_returnflag = 'R') as returned, count_if(l_linestatus = 'O') as open_lines,
    count_if(l_discount > 0.05) as discounted, count_if(l_quantity > 25) as large from lineitem""")
def stats(spark, sf):
    c = F.col
    return r.stats(read(spark, sf, "lineitem"), returned=c("l_returnflag") == "R", open_lines=c("l_linestatus") == "O", discounted=c("l_discount") > 0.05, large=c("l_quantity") > 25)


@query("status_overview", """with a as (select c_custkey as k, sha256(c_mktsegment) as h from customer where c_custkey % 10 <> 0),
    b as (select c_custkey as k, sha256(case when c_custkey % 13 = 0 then 'x' else c_mktsegment end) as h from customer where c_custkey % 7 <> 0)
    select case when a.k is null then 'new' when b.k is null then 'deleted' when a.h = b.h then 'fresh' else 'stale' end as state, count(*) as n from a full join b on a.k = b.k group by 1""")
def status(spark, sf):
    c = read(spark, sf, "customer")
    old = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("path"), F.sha2("c_mktsegment", 256).alias("hash"))
    new = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("path"), F.sha2(F.when(F.col("c_custkey") % 13 == 0, "x").otherwise(F.col("c_mktsegment")), 256).alias("hash"))
    return r.status(old, new)


@query("cov_entity", f"with {COVERAGE} select entity, count(*) as tracked, count_if(hits > 0) as covered, {RATIO.format('count_if(hits > 0) * 100', 'count(*)', 2)} as pct, coalesce(list(line order by line) filter (where hits = 0), [])::varchar as uncovered from coverage group by entity")
def cov_entity(spark, sf):
    found = r.entity_coverage(coverage(spark, sf))
    return found.withColumn("uncovered", F.concat(F.lit("["), F.array_join(F.col("uncovered").cast("array<string>"), ", "), F.lit("]")))


@query("cov_uncovered", f"with {COVERAGE} select entity, count(*) as tracked, count_if(hits > 0) as covered, {RATIO.format('count_if(hits > 0) * 100', 'count(*)', 2)} as pct from coverage group by entity having count(*) > 0 and {RATIO.format('count_if(hits > 0) * 100', 'count(*)', 2)} < 50")
def cov_uncovered(spark, sf):
    return r.uncovered(coverage(spark, sf), 50)


@query("cov_by_group", f"""select l_linestatus, l_returnflag, count(distinct l_orderkey) as total, count(distinct case when l_quantity > 40 then l_orderkey end) as hits,
    {RATIO.format('count(distinct case when l_quantity > 40 then l_orderkey end)', 'count(distinct l_orderkey)', 4)} as ratio from lineitem group by all""")
def cov_by_group(spark, sf):
    return r.grouped_ratio(read(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"], F.col("l_orderkey"), F.col("l_quantity") > 40)


@query("test_ratio", f"""select p_brand as module, count(*) as entities, count_if(tested) as tested, count_if(tested) > 0 as has_tests, {RATIO.format('count_if(tested)', 'count(*)', 4)} as ratio
    from (select p_brand, p_partkey in (select l_partkey from lineitem where l_quantity = 50) as tested from part) group by p_brand""")
def test_ratio(spark, sf):
    tested = read(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("t", F.lit(1))
    rows = read(spark, sf, "part").join(tested, "p_partkey", "left")
    n = F.count("t")
    return rows.groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("entities"), n.alias("tested"), (n > 0).alias("has_tests"), ratio(n, F.count("*")).alias("ratio"))


@query("test_stability", f"""with t as (select user_id, case when event_type = 'error' then 'failed' else 'passed' end as status, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
    select user_id, count(*) as n, count_if(status = 'passed') as passed, {RATIO.format("count_if(status = 'passed')", 'count(*)', 4)} as pass_rate, round(avg(value), 3) as avg_ms from t where n <= 50 group by user_id""")
def stability(spark, sf):
    runs = read(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("passed")).withColumnRenamed("value", "duration")
    return r.stability(runs, "user_id", "ts", tie="event_id")


@query("evo_frequency", """with e as (select user_id % 20 as entity, user_id, epoch(ts) as s, event_id from events),
    g as (select *, s - lag(s) over (partition by entity order by s) as gap from e)
    select entity, count(*) as n, min(s)::double as first_seen, max(s)::double as last_seen, count(distinct user_id) as authors, round(avg(gap), 2) as avg_interval_s from g group by entity""")
def freq(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("entity"), F.col("user_id").alias("author"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return r.frequency(e, ["entity"])


@query("evo_histogram", """select grain, bucket, count(*) as n from (select unnest([{'grain': 'day', 'bucket': strftime(ts, '%Y-%m-%d')}, {'grain': 'week', 'bucket': strftime(ts, '%Y-W%W')},
    {'grain': 'month', 'bucket': strftime(ts, '%Y-%m')}], recursive := true) from events) group by all""")
def hist(spark, sf):
    return r.histogram(read(spark, sf, "events"))


@query("evo_churn", f"""with c as (select c_nationkey, sum(floor(o_totalprice) + floor(o_totalprice / 2))::bigint as churn from orders join customer on c_custkey = o_custkey group by 1),
    s as (select c_nationkey, count(*) as size from customer group by 1)
    select c_nationkey, churn, {RATIO.format('churn', 'size', 4)} as rate from c left join s using (c_nationkey) order by churn desc, c_nationkey limit 10""")
def churn(spark, sf):
    both = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    both = both.select("c_nationkey", F.floor("o_totalprice").alias("added"), F.floor(F.col("o_totalprice") / 2).alias("deleted"))
    return r.churn(both, read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size")), ["c_nationkey"])


@query("evo_size_churn", """with v as (select conv_id, turn, length(text) as l, length(text) - lag(length(text)) over (partition by conv_id order by turn) as d from conversations)
    select conv_id, coalesce(sum(abs(d)), 0)::bigint as churn, count(*) as n_versions from v group by conv_id""")
def size_churn(spark, sf):
    v = read(spark, sf, "conversations").withColumn("size", F.length("text"))
    return r.size_churn(v, "conv_id", "turn", "size")


@query("evo_hotspots", """with m as (select user_id as entity, count(*) as freq, count_if(event_type = 'error') as defects, max(value) as complexity from events group by user_id)
    select entity, freq, defects, complexity, round(freq::double / max(freq) over () * 0.4 + coalesce(defects::double / nullif(max(defects) over (), 0), 0) * 0.3 + complexity / max(complexity) over () * 0.3, 4) as score from m""")
def hot(spark, sf):
    m = read(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("freq"), F.count_if(F.col("event_type") == "error").alias("defects"), F.max("value").alias("complexity"))
    return r.hotspots(m, {"freq": 0.4, "defects": 0.3, "complexity": 0.3})


@query("evo_hotspot_labels", """with m as (select user_id, json_extract_string(props, '$.k') as rule, count(*) as changes, (epoch(timestamp '2024-01-31') - epoch(max(ts))) / 86400 as days from events group by all)
    select user_id, rule, changes, case when changes > 5 and days <= 30 then 'persistent' when changes between 3 and 5 and days <= 7 then 'emerging' end as label from m""")
def hotspot_labels(spark, sf):
    m = read(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("rule")).agg(F.count("*").alias("changes"), F.max("ts").alias("last"))
    days = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86400e6
    return m.select("user_id", "rule", "changes", r.hotspot_label(F.col("changes"), days).alias("label"))


@query("defect_rate", f"select user_id, count(*) as changes, count_if(event_type = 'error') as defects, {RATIO.format(chr(99) + 'ount_if(event_type = ' + chr(39) + 'error' + chr(39) + ')', 'count(*)', 4)} as rate from events group by user_id")
def defect_rate(spark, sf):
    n = F.count_if(F.col("event_type") == "error")
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("changes"), n.alias("defects"), ratio(n, F.count("*")).alias("rate"))


@query("health_score", """with c as (select p_brand as module, count_if(p_size >= 45) as high, count_if(p_size >= 35 and p_size < 45) as medium, count_if(p_size >= 30 and p_size < 35) as low from part group by 1),
    s as (select *, greatest(0, 100 - high * 5 - medium * 2 - low * 0.5)::double as score from c)
    select *, case when score >= 90 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'fair' else 'poor' end as level from s""")
def health(spark, sf):
    s = F.col("p_size")
    counts = read(spark, sf, "part").groupBy(F.col("p_brand").alias("module")).agg(F.count_if(s >= 45).alias("high"), F.count_if((s >= 35) & (s < 45)).alias("medium"), F.count_if((s >= 30) & (s < 35)).alias("low"))
    return r.health(counts)


@query("metrics_summary", """select p_brand as module, count(*) as n, round(avg(p_size), 4) as avg_size, max(p_size) as max_size, count_if(p_size <= 5) as b5, count_if(p_size between 6 and 10) as b10,
    count_if(p_size between 11 and 20) as b20, count_if(p_size > 20) as more from part group by 1""")
def summary(spark, sf):
    s = F.col("p_size")
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("module")).agg(
        F.count("*").alias("n"), F.round(F.avg(s), 4).alias("avg_size"), F.max(s).alias("max_size"), F.count_if(s <= 5).alias("b5"),
        F.count_if(s.between(6, 10)).alias("b10"), F.count_if(s.between(11, 20)).alias("b20"), F.count_if(s > 20).alias("more"),
    )


@query("largest_entities", "select p_partkey, p_name, p_size from part order by p_size desc, p_partkey limit 25")
def largest(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(25)


@query("risk_list", f"""with {FINDINGS}, x as (select user_id, 'errors' as risk, count_if(severity = 'ERROR') as n from findings group by user_id union all select user_id, 'warnings', count_if(severity = 'WARNING') from findings group by user_id)
    select user_id, risk, n, case when n > 6 then 'high' when n > 4 then 'medium' else 'low' end as level from x order by case when n > 6 then 0 when n > 4 then 1 else 2 end, n desc, user_id, risk limit 40""")
def risks(spark, sf):
    f = findings(spark, sf)
    each = f.groupBy("user_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    rows = each.unpivot("user_id", ["errors", "warnings"], "risk", "n").withColumn("level", risk_of(F.col("n"), 6, 4))
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("n"), "user_id", "risk").limit(40)


@query("dashboard", f"""with {FINDINGS} select 'entities' as section, count(*)::bigint as value from part union all select 'edges', count(*) from lineitem union all select 'findings', count(*) from findings
    union all select 'errors', count_if(severity = 'ERROR') from findings union all select 'documents', count(*) from documents union all select 'vectors', count(*) from embeddings union all select 'versions', count(*) from conversations""")
def dashboard(spark, sf):
    one = lambda name, df, agg=None: df.agg((agg if agg is not None else F.count("*")).alias("value")).select(F.lit(name).alias("section"), "value")
    f = findings(spark, sf)
    parts = [one("entities", read(spark, sf, "part")), one("edges", read(spark, sf, "lineitem")), one("findings", f), one("errors", f, F.count_if(F.col("severity") == "ERROR"))]
    parts += [one(n, read(spark, sf, t)) for n, t in (("documents", "documents"), ("vectors", "embeddings"), ("versions", "conversations"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("finding_stats", f"with {FINDINGS} select severity, rule, count(*) as n, grouping_id(severity, rule)::int as level from findings group by grouping sets ((severity), (rule), ()) ")
def finding_stats(spark, sf):
    f = findings(spark, sf)
    return f.groupingSets([[F.col("severity")], [F.col("rule")], []], "severity", "rule").agg(F.count("*").alias("n"), F.grouping_id("severity", "rule").cast("int").alias("level"))


@query("findings_filtered", f"with {FINDINGS} select id, rule, severity, user_id from findings where severity <> 'INFO' and user_id % 3 = 0 order by severity = 'ERROR' desc, severity, id limit 100")
def findings_filtered(spark, sf):
    f = findings(spark, sf).where("severity <> 'INFO' and user_id % 3 = 0").select("id", "rule", "severity", "user_id")
    return f.orderBy((F.col("severity") == "ERROR").desc(), "severity", "id").limit(100)


@query("symbol_issues", f"""with {FINDINGS}, g as (select event_id as id, 'guard' as source, case when value > 80 then 'block' else 'warn' end as severity, user_id from events where event_type = 'purchase')
    select * from (select id, 'scan' as source, severity, user_id from findings where severity <> 'INFO' union all select * from g)
    order by case severity when 'block' then 0 when 'ERROR' then 0 when 'warn' then 1 when 'WARNING' then 1 else 2 end, id, source limit 200""")
def symbol_issues(spark, sf):
    f = findings(spark, sf).where("severity <> 'INFO'").select("id", F.lit("scan").alias("source"), "severity", "user_id")
    g = read(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit("guard").alias("source"), F.when(F.col("value") > 80, "block").otherwise("warn").alias("severity"), "user_id")
    rank = F.when(F.col("severity").isin("block", "ERROR"), 0).when(F.col("severity").isin("warn", "WARNING"), 1).otherwise(2)
    return f.unionByName(g, allowMissingColumns=True).orderBy(rank, "id", "source").limit(200)


@query("defect_patterns", f"""with {FINDINGS} select rule, count(*) as cases, ['INFO', 'WARNING', 'ERROR'][max(case severity when 'ERROR' then 3 when 'WARNING' then 2 else 1 end)] as severity, count(distinct user_id) as users from findings group by rule""")
def defect_patterns(spark, sf):
    return r.patterns(findings(spark, sf))


@query("defect_suggest", f"""with {FINDINGS}, cases as (select rule, count(*) as cases from findings group by rule),
    fixes as (select json_extract_string(props, '$.k') as rule, event_id as fix, value / 100 as effectiveness from events where event_type = 'purchase' and user_id % 5 = 0),
    best as (select *, row_number() over (partition by rule order by effectiveness desc, fix) as n from fixes),
    m as (select rule, avg(effectiveness) as e, count(*) as k from best where n <= 5 group by rule)
    select rule, coalesce(k, 0) as n_fixes, round(coalesce(e, least(0.5::double, cases * 0.05::double)), 4) as confidence from cases left join m using (rule)""")
def suggest(spark, sf):
    fixes = read(spark, sf, "events").where("event_type = 'purchase' and user_id % 5 = 0").select(F.get_json_object("props", "$.k").alias("rule"), F.col("event_id").alias("fix"), (F.col("value") / 100).alias("effectiveness"))
    return r.suggest(fixes, findings(spark, sf).groupBy("rule").agg(F.count("*").alias("cases")))


@query("ownership_map", """with e as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all)
    select c_nationkey, count(*) as owners, sum(n)::bigint as files, arg_min(c_mktsegment, {'n': -n, 'o': c_mktsegment}) as primary_owner from e group by 1""")
def owners(spark, sf):
    return r.ownership(read(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("savings_rollup", """select o_orderpriority, count(*) as n, round(sum(o_totalprice * 0.1), 2) as saved, round(avg(0.1::double), 4) as avg_pct, grouping(o_orderpriority)::int as is_total from orders group by rollup(o_orderpriority)""")
def savings(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") * 0.1).alias("saved_"), F.lit(0.1).alias("pct"))
    return r.savings(rows, "o_orderpriority", "saved_", "pct")


@query("metric_percentiles", "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def percentiles(spark, sf):
    return r.percentiles(read(spark, sf, "events"), "value", ["event_type"])


@query("metric_rates", f"select event_type, count(*) as n, {RATIO.format('count_if(value > 50)', 'count(*)', 4)} as hit_rate, {RATIO.format('count(*) - count(distinct user_id)', 'count(*)', 4)} as duplicate_rate from events group by event_type")
def rates(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), ratio(F.count_if(F.col("value") > 50), F.count("*")).alias("hit_rate"), ratio(F.count("*") - F.countDistinct("user_id"), F.count("*")).alias("duplicate_rate"),
    )


@query("edit_stats", "select s as event_type, count(event_id) as n from (values ('click'), ('error'), ('reverted'), ('purchase')) t(s) left join events on event_type = s group by s")
def edit_stats(spark, sf):
    return r.zero_filled(read(spark, sf, "events"), "event_type", ["click", "error", "reverted", "purchase"])


@query("commit_list", "select o_orderkey, o_custkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 10")
def commits(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(10).limit(20)


@query("git_stats", "select count(*) as commits, count(distinct o_custkey) as authors, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from orders")
def git_stats(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read(spark, sf, "orders").agg(F.count("*").alias("commits"), F.countDistinct("o_custkey").alias("authors"), day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"))


@query("project_brief", """with l as (select lang, count(*) as n from documents group by lang) select source as module, count(*) as n,
    (select arg_min(lang, {'n': -n, 'l': lang}) from l) as main_language from documents group by source order by n desc, module limit 20""")
def brief(spark, sf):
    d = read(spark, sf, "documents")
    main = d.groupBy("lang").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col("lang").alias("l")))["l"].alias("main_language"))
    return d.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(20).crossJoin(F.broadcast(main))  # one row


@query("cross_repo_summary", """with w as (select n_nationkey, n_name from nation), c as (select c_nationkey, count(*) as customers, count(distinct c_mktsegment) as segments from customer group by 1),
    s as (select s_nationkey, count(*) as suppliers from supplier group by 1)
    select n_name, coalesce(customers, 0) as customers, coalesce(segments, 0) as segments, coalesce(suppliers, 0) as suppliers from w left join c on c_nationkey = n_nationkey left join s on s_nationkey = n_nationkey""")
def cross_repo(spark, sf):
    n = read(spark, sf, "nation")
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))
    s = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    both = n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return both.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "segments", "suppliers")])


@query("uncommented_ranked", """select p_brand, p_type, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey) as n from part) where n = 1""")
def uncommented(spark, sf):
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), "p_partkey"))
    return read(spark, sf, "part").withColumn("n", rank).where("n = 1").select("p_brand", "p_type", "p_partkey")


@query("storm_window", """with e as (select event_id, ts, count(*) over (order by ts range between interval 1 hour preceding and current row) as n from events) select event_id, n, n >= 25 as storm from e where n >= 25""")
def storm(spark, sf):
    from ..streaming.events import trailing_counts

    return trailing_counts(read(spark, sf, "events"), "ts", 3600).where("n >= 25").select("event_id", "n", (F.col("n") >= 25).alias("storm"))


@query("scope_rules", """with c as (select c_custkey as rule, c_custkey % 4 as kind, c_mktsegment = 'BUILDING' as segment, c_name = 'Customer#000000001' or c_name[1:9] = 'Customer#' as name from customer)
    select rule, case kind when 0 then 0 when 3 then 2 else 1 end as specificity from c where case kind when 0 then true when 1 then segment when 2 then name else segment and name end""")
def scope(spark, sf):
    """A rule a customer: for all, for its segment, for names that begin like its own, or for both."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("rule"), (F.col("c_custkey") % 4).alias("kind"), F.array("c_mktsegment").alias("lang"), F.array(F.concat(F.substring("c_name", 1, 9), F.lit("*"))).alias("path"))
    asked = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), F.col(c)).alias(c)
    rules = rows.select("rule", F.to_json(F.struct(asked("lang", 1, 3), asked("path", 2, 3))).alias("scope"))
    return r.scope_matches(rules, {"lang": "BUILDING", "path": "Customer#000000001"}).select("rule", "specificity")


@query("file_levels", "select doc_id, case when n_chars >= 20000 then 'critical' when n_chars >= 10000 then 'high' when n_chars >= 5000 then 'medium' else 'ok' end as level from documents")
def file_levels(spark, sf):
    return read(spark, sf, "documents").select("doc_id", r.levels(F.col("n_chars"), (20000, "critical"), (10000, "high"), (5000, "medium")).alias("level"))


_QUANTITY = "select l_orderkey as item, sum(l_quantity)::bigint as value from lineitem group by 1"


@query("health_categories", f"""with m as (select 'large_files' as category, doc_id::varchar as item, n_chars::bigint as value, 2000 as h, 1000 as m, 500 as l from documents
    union all select 'complex_functions', p_partkey::varchar, p_size, 30, 20, 10 from part union all select 'long_functions', item::varchar, value, 200, 100, 50 from ({_QUANTITY}))
    select category, item, value, case when value >= h then 'high' when value >= m then 'medium' else 'low' end as severity from m where value >= l""")
def health_categories(spark, sf):
    quantity = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("value"))
    files = read(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("value"))
    return r.health_frames({"large_files": files, "complex_functions": read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("value")), "long_functions": quantity})


@query("risk_classes", f"""with {FINDINGS}, m as (select 'high_complexity' as type, case when p_size > 30 then 'high' else 'medium' end as severity, p_partkey::varchar as item, p_size::bigint as value from part where p_size > 20
    union all select 'oversized_function', case when n_chars > 1000 then 'high' else 'medium' end, doc_id::varchar, n_chars from documents where n_chars > 500
    union all select 'blocking_finding', 'high', id::varchar, 1 from findings where severity = 'ERROR'
    union all select 'broken_audit', 'high', conv_id::varchar, count(*) from conversations group by conv_id having max(turn) + 1 <> count(*)
    union all select 'db_stale', 'medium', 'orders', 1 where (select max(o_orderdate) from orders) < (select max(l_shipdate) from lineitem))
    select type, severity, item, value from m qualify row_number() over (partition by type order by value desc, item) <= 15""")
def risk_classes(spark, sf):
    one = lambda df, item, value: df.select(F.col(item).alias("item"), F.col(value).alias("value"))
    audits = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.count("*").alias("value"), F.max("turn").alias("_last")).where("_last + 1 <> value")
    ends = read(spark, sf, "orders").agg(F.max("o_orderdate").alias("a")).crossJoin(read(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("b")))  # one row each
    return r.risks({
        "high_complexity": one(read(spark, sf, "part"), "p_partkey", "p_size"),
        "oversized_function": one(read(spark, sf, "documents"), "doc_id", "n_chars"),
        "blocking_finding": findings(spark, sf).where("severity = 'ERROR'").select(F.col("id").alias("item"), F.lit(1).alias("value")),
        "broken_audit": audits.select("item", "value"),
        "db_stale": ends.where("a < b").select(F.lit("orders").alias("item"), F.lit(1).alias("value")),
    })


@query("dependency_providers", """select o_orderkey, count(s_suppkey) as providers, case when count(s_suppkey) = 1 then min(s_suppkey) end as chosen
    from orders join customer on c_custkey = o_custkey left join supplier on s_nationkey = c_nationkey group by o_orderkey""")
def providers(spark, sf):
    """Suppliers are counted by nation first: an order meets a row, not each supplier of its nation."""
    by_nation = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("providers"), F.min("s_suppkey").alias("least"))
    own = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(by_nation, "c_nationkey", "left")
    n = F.coalesce("providers", F.lit(0))
    return own.select("o_orderkey", n.cast("long").alias("providers"), F.when(n == 1, F.col("least")).alias("chosen"))


@query("attribution", """select c_custkey, count(distinct o_orderkey) as commits, count(*) as changes, count(distinct l_partkey) as symbols from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1""")
def attribution(spark, sf):
    return _attribution(spark, sf, read(spark, sf, "orders"))


def _attribution(spark, sf, orders):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    mine = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    both = lines.join(mine, "o_orderkey").join(read(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return both.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("commits"), F.count("*").alias("changes"), F.countDistinct("l_partkey").alias("symbols"))


@query("pr_check", f"""with {FINDINGS}, changed as (select distinct user_id from events where event_type = 'purchase' and value > 90)
    select user_id, count(*) as open_findings, count_if(severity = 'ERROR') as errors, count_if(severity = 'ERROR') > 0 as blocked from findings where user_id in (select user_id from changed) group by user_id""")
def pr_check(spark, sf):
    changed = read(spark, sf, "events").where("event_type = 'purchase' and value > 90").select("user_id")
    errors = F.count_if(F.col("severity") == "ERROR")
    return findings(spark, sf).join(changed, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("open_findings"), errors.alias("errors"), (errors > 0).alias("blocked"))


VALUE_BOUNDS = (10.0, 25.0, 50.0, 75.0, 90.0)


@query("metrics_buckets", """select event_type, le::double as le, count(*) filter (where value <= le) as n from events, (values (10.0::double), (25), (50), (75), (90), ('inf'::double)) b(le) group by event_type, le""")
def metrics_buckets(spark, sf):
    """Histograms by hour, merged by type."""
    hours = h.observe(read(spark, sf, "events"), "value", "event_type", F.date_trunc("hour", "ts").alias("hour"), bounds=VALUE_BOUNDS)
    return h.buckets(h.merge(hours, "event_type", bounds=VALUE_BOUNDS), "event_type", bounds=VALUE_BOUNDS)
