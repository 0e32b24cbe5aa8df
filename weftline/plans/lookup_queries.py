"""Look-ups over the test tables in the roles of registries, jobs, artifacts and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph as g
from ..operators import lookups as o
from ..operators import similarity as s
from .adapters import EDGES, FINDINGS, SNAPSHOTS, edges, findings, read, snapshots

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _definitions(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"))


@query("symbol_location", "select name, arg_min(file, [file, lpad(start_line::varchar, 9, '0'), lpad(id::varchar, 20, '0')]) as file, arg_min(start_line, [file, lpad(start_line::varchar, 9, '0'), lpad(id::varchar, 20, '0')]) as start_line from (select p_partkey as id, p_type as name, p_brand as file, p_size as start_line from part) group by name")
def symbol_location(spark, sf):
    return o.first_by(_definitions(spark, sf), ["name"], ["file", "start_line", "id"]).select("name", "file", "start_line")


@query("symbol_by_name_and_file", "select p_type as name, p_brand as file, min(p_size) as start_line, arg_min(p_partkey, p_size::bigint * 1000000000 + p_partkey) as id from part group by 1, 2")
def symbol_by_name_and_file(spark, sf):
    return o.first_by(_definitions(spark, sf), ["name", "file"], ["start_line", "id"]).select("name", "file", "start_line", "id")


@query("file_symbols", "select p_brand as file, p_partkey as id, row_number() over (partition by p_brand order by p_size, p_partkey)::int as position from part")
def file_symbols(spark, sf):
    return o.newest(_definitions(spark, sf), "file", [F.col("start_line"), F.col("id")], 1 << 30).select("file", "id", F.col("rank").alias("position"))


@query("latest_commented", "select conv_id, max(turn) as turn, sha256(arg_max(text, turn)) as hash from conversations where role = 'assistant' and trim(text) <> '' group by conv_id")
def latest_commented(spark, sf):
    rows = read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return o.latest_commented(rows, "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("text", 256).alias("hash"))


@query("commit_history", """with h as (select l_partkey, o_orderkey, l_linenumber, row_number() over (partition by l_partkey order by o_orderdate desc, o_orderkey desc, l_linenumber desc) as rank from lineitem join orders on o_orderkey = l_orderkey)
    select l_partkey, o_orderkey, l_linenumber, rank::int as rank from h where rank <= 20""")
def commit_history(spark, sf):
    both = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber").join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return o.newest(both, "l_partkey", [F.desc("o_orderdate"), F.desc("o_orderkey"), F.desc("l_linenumber")], 20).select("l_partkey", "o_orderkey", "l_linenumber", "rank")


@query("job_stats", "select category, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('cancelled')) c(category) left join orders on o_orderstatus = category group by category")
def job_stats(spark, sf):
    return o.counts_by(read(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "cancelled"])


@query("job_list", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') and o_orderpriority like '1%' order by o_orderdate desc, o_orderkey limit 50")
def job_list(spark, sf):
    return read(spark, sf, "orders").where("o_orderstatus in ('O', 'P') and o_orderpriority like '1%'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@query("workspace_list", "select n_nationkey, n_name, count(c_custkey) as n_symbols, n_regionkey = 1 as is_active from nation left join customer on c_nationkey = n_nationkey group by all")
def workspace_list(spark, sf):
    symbols = read(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return o.registry(read(spark, sf, "nation"), symbols, "n_nationkey", F.col("n_regionkey") == 1).select("n_nationkey", "n_name", "n_symbols", "is_active")


@query("clone_group_detail", "select substr(sha256('1:' || h), 1, 16) as group_hash, 1 as clone_type, first as representative, doc_id as member from (select doc_id, sha256(text) as h, count(*) over (partition by text) as n, min(doc_id) over (partition by text) as first from documents where text is not null) where n > 1")
def clone_group_detail(spark, sf):
    rows = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return o.group_members(rows, "content_hash", 1)


@query("token_savings_record", "select l_orderkey, l_linenumber, greatest(l_quantity - l_quantity * l_discount * 10, 0) as saved, coalesce(round(greatest(l_quantity - l_quantity * l_discount * 10, 0) * 100 / nullif(l_quantity, 0), 2), 0)::double as saved_pct from lineitem")
def token_savings_record(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("original"), (F.col("l_quantity") * F.col("l_discount") * 10).alias("actual"))
    return o.savings(rows, "original", "actual").select("l_orderkey", "l_linenumber", "saved", "saved_pct")


@query("artifact_freshness", "select o_orderkey, case when c_custkey is null then 'orphaned' when o_custkey % 25 = c_nationkey then 'fresh' else 'stale' end as state from orders left join customer on c_custkey = o_custkey and c_custkey % 3 <> 0")
def artifact_freshness(spark, sf):
    artifacts = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("built_from"))
    providers = read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    revision = artifacts.join(providers, "o_custkey").select("o_orderkey", F.col("c_nationkey").alias("revision"))
    return o.freshness(artifacts, revision, "o_orderkey", "built_from", "revision")


@query("blame_owners", """with e as (select l_partkey as file, o_custkey::varchar as author, count(*) as n, max(o_orderdate) as t from lineitem join orders on o_orderkey = l_orderkey group by all),
    r as (select *, sum(n) over (partition by file) as total, row_number() over (partition by file order by t desc, author) as k from e)
    select file, author as owner, round(n::double / total, 4) as confidence from r where k = 1""")
def blame_owners(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return o.blame_owners(both.select(F.col("l_partkey").alias("file"), F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("ts")), "file", "author", "ts")


@query("vulnerability_risk", f"""with recursive {EDGES}, steps as (select distinct src, dst from edges where src <> dst), {FINDINGS},
    walk(source, node, depth) as (select id, id % (select count(*) from part), 0 from findings union select w.source, s.src, w.depth + 1 from walk w join steps s on s.dst = w.node where w.depth < 1),
    n as (select source, count(distinct node) - 1 as reached from walk group by source)
    select id, severity, reached, case when severity = 'ERROR' and reached > 10 then 'critical' when severity = 'ERROR' and reached > 3 then 'high' when severity = 'WARNING' then 'medium' else 'low' end as risk from findings join n on source = id""")
def vulnerability_risk(spark, sf):
    n = read(spark, sf, "part").count()
    found = findings(spark, sf).select("id", "severity")
    seeds = found.select(F.col("id").alias("source"), (F.col("id") % n).alias("node"))
    reached = g.reach(edges(spark, sf), seeds, 1, up=True).groupBy(F.col("source").alias("id")).agg((F.countDistinct("node") - 1).alias("reached"))
    return found.join(reached, "id").withColumn("risk", o.finding_risk(F.col("severity"), F.col("reached")))


@query("finding_top", f"""with {FINDINGS}, c as (select 'severity' as dimension, severity as value, count(*) as n from findings group by 2 union all select 'rule', rule, count(*) from findings group by 2 union all select 'user_id', user_id::varchar, count(*) from findings group by 2)
    select dimension, value, n from (select *, row_number() over (partition by dimension order by n desc, value nulls first) as r from c) where r <= 20""")
def finding_top(spark, sf):
    return o.top_counts(findings(spark, sf), ["severity", "rule", "user_id"], 20)


@query("test_failures", """select user_id, event_id, rank::int as rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events where event_type = 'error') where rank <= 10""")
def test_failures(spark, sf):
    failed = read(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return o.newest(failed, "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "rank")


@query("churn_daily", "select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as commits, sum(floor(o_totalprice))::bigint as churn from orders group by 1")
def churn_daily(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return read(spark, sf, "orders").groupBy(day).agg(F.count("*").alias("commits"), F.sum(F.floor("o_totalprice")).alias("churn"))


@query("status_extensions", "select coalesce(nullif(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([A-Za-z0-9]+)$', 1), ''), 'none') as extension, count(*) as files, count_if(html like '%<p>%') as parsed, round(count_if(html like '%<p>%')::double / count(*), 4) as rate from pages group by 1")
def status_extensions(spark, sf):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    extension = F.coalesce(F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("none"))
    parsed = F.count_if(F.col("html").contains("<p>"))
    return read(spark, sf, "pages").groupBy(extension.alias("extension")).agg(F.count("*").alias("files"), parsed.alias("parsed"), g.ratio(parsed, F.count("*")).alias("rate"))


@query("delta_calls", f"""with {SNAPSHOTS}, a as (select module, signature % 97 as callee, count(*) as n from olds group by all), b as (select module, signature % 97 as callee, count(*) as n from news group by all)
    select coalesce(a.module, b.module) as module, coalesce(a.callee, b.callee) as callee, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.module = b.module and a.callee = b.callee where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def delta_calls(spark, sf):
    old, new = [df.groupBy("module", (F.col("signature") % 97).alias("callee")).agg(F.count("*").alias("n")) for df in snapshots(spark, sf)]
    both = old.withColumnRenamed("n", "a").join(new.withColumnRenamed("n", "b"), ["module", "callee"], "full")
    delta = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return both.select("module", "callee", delta.alias("delta")).where("delta != 0")


@query("scalar_fnv", "select p_partkey, list_reduce([2166136261::ubigint] || list_transform(string_split(p_name || '#' || p_partkey, ''), lambda c: ascii(c)::ubigint), lambda h, x: (xor(h, x) * 16777619::ubigint) & 4294967295::ubigint)::bigint as hash from part")
def scalar_fnv(spark, sf):
    return read(spark, sf, "part").select("p_partkey", s.fnv1a_column(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))).alias("hash"))


@query("manifest_dependencies", r"""with m as (select s_suppkey, unnest(['lib-' || (s_suppkey % 7) || '>=' || s_suppkey || '.1', '# no', 'Tool_' || s_suppkey || ' == 2.' || (s_suppkey % 5) || ' ; python_version > "3"', 'bare' || (s_suppkey % 3)]) as line from supplier)
    select s_suppkey, lower(regexp_extract(line, '^\s*([A-Za-z0-9_.-]+)', 1)) as name, trim(regexp_extract(line, '^\s*[A-Za-z0-9_.-]+\s*((?:[<>=!~^]=?=?\s*[^;#,\s]+)?)', 1)) as requirement from m where not starts_with(line, '#')""")
def manifest_dependencies(spark, sf):
    from ..sources.code import requirement_lines

    lines = F.expr("""array(concat('lib-', s_suppkey % 7, '>=', s_suppkey, '.1'), '# no', concat('Tool_', s_suppkey, ' == 2.', s_suppkey % 5, ' ; python_version > "3"'), concat('bare', s_suppkey % 3))""")
    return requirement_lines(read(spark, sf, "supplier").select("s_suppkey", F.explode(lines).alias("line")), "line").select("s_suppkey", "name", "requirement")


@query("context_hashes", """select c_mktsegment, sha256(array_to_string(list_sort(list_distinct(list('-D' || c_nationkey))), chr(10))) as hash from customer group by 1""")
def context_hashes(spark, sf):
    flags = F.sort_array(F.collect_set(F.concat(F.lit("-D"), F.col("c_nationkey").cast("string"))))
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sha2(F.array_join(flags, "\n"), 256).alias("hash"))


@query("query_window", "select event_id from events where epoch(ts) >= (select epoch(max(ts)) - 7 * 86400 from events)")
def query_window(spark, sf):
    e = read(spark, sf, "events")
    last = e.agg((F.unix_timestamp(F.max("ts")) - scalars.window_seconds("7d")).alias("cut"))
    return e.crossJoin(F.broadcast(last)).where("unix_timestamp(ts) >= cut").select("event_id")  # one row
