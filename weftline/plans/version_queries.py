"""History, diff, delta, garbage collection and chain queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import versioning as o
from .adapters import EDGES, SNAPSHOTS, VERSIONS, edges, read, snapshots, versions

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("hist_versions", f"with {VERSIONS} select entity, version, name, hash from versions")
def hist(spark, sf):
    return versions(spark, sf).select("entity", "version", "name", "hash")


@query("hist_recent_changes", f"""with {VERSIONS} select entity, version, case when lag(hash) over w is null then 'added' when lag(hash) over w <> hash then 'modified' else 'none' end as change
    from versions window w as (partition by entity order by version)""")
def recent(spark, sf):
    return o.recent_changes(versions(spark, sf).drop("text")).select("entity", "version", "change")


@query("hist_version_diff", f"""with {VERSIONS}, x as (select a.entity, a.version, a.name as new, b.name as old, a.hash as h1, b.hash as h0 from versions a join versions b on a.entity = b.entity and b.version = a.version - 1)
    select entity, version, count_if(new <> old) as added, count_if(new <> old) as removed, count_if(new = old and h0 <> h1) as modified from x group by all""")
def version_diff(spark, sf):
    return o.version_diff(versions(spark, sf), "entity", "version", "name", "hash")


@query("hist_latest", f"with {VERSIONS} select entity, max(version) as version, arg_max(hash, version) as hash, max(version) + 1 as next_version from versions where name = 'assistant' group by entity")
def latest(spark, sf):
    return versions(spark, sf).where("name = 'assistant'").groupBy("entity").agg(F.max("version").alias("version"), F.max_by("hash", "version").alias("hash"), (F.max("version") + 1).alias("next_version"))


@query("hist_tombstones", "select c_custkey, 1 as is_deleted from customer where c_custkey % 10 <> 0 and c_custkey % 7 = 0")
def tombs(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey")
    return o.tombstones(c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 7 <> 0"), ["c_custkey"])


@query("diff_branches", f"""with {SNAPSHOTS} select case when a.id is null then 'added' when b.id is null then 'removed' when a.signature is not distinct from b.signature then 'unchanged' else 'modified' end as change, count(*) as n
    from olds a full join news b on a.id = b.id group by 1""")
def branches(spark, sf):
    old, new = snapshots(spark, sf)
    return o.diff(old, new, "id", "signature").groupBy("change").agg(F.count("*").alias("n"))


SNAP_EDGES = """oe as (select distinct c_custkey as src, c_nationkey::bigint as dst from customer where c_custkey % 10 <> 0 and c_custkey % 5 <> 0),
ne as (select distinct c_custkey as src, case when c_custkey % 17 = 0 then 1 else c_nationkey end::bigint as dst from customer where c_custkey % 7 <> 0 and c_custkey % 5 <> 1)"""


def _snapshot_edges(spark, sf):
    c = read(spark, sf, "customer")
    old = c.where("c_custkey % 10 <> 0 and c_custkey % 5 <> 0").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    new = c.where("c_custkey % 7 <> 0 and c_custkey % 5 <> 1").select(F.col("c_custkey").alias("src"), F.when(F.col("c_custkey") % 17 == 0, 1).otherwise(F.col("c_nationkey")).cast("long").alias("dst"))
    return old.distinct(), new.distinct()


@query("diff_snapshot", f"""with {SNAPSHOTS}, {SNAP_EDGES},
    ra as (select dst as id, count(*) as n from (select * from ne except select * from oe) group by 1), rr as (select dst as id, count(*) as n from (select * from oe except select * from ne) group by 1),
    ea as (select src as id, count(*) as n from (select * from ne except select * from oe) group by 1), er as (select src as id, count(*) as n from (select * from oe except select * from ne) group by 1),
    x as (select coalesce(a.id, b.id) as id, a.id as i0, b.id as i1, a.module as m0, b.module as m1, a.signature as s0, b.signature as s1 from olds a full join news b on a.id = b.id),
    y as (select x.*, case when i0 is null or i1 is null then 0 else coalesce(ra.n, 0) end as ra, case when i0 is null or i1 is null then 0 else coalesce(rr.n, 0) end as rr,
        case when i0 is null or i1 is null then 0 else coalesce(ea.n, 0) end as ea, case when i0 is null or i1 is null then 0 else coalesce(er.n, 0) end as er
        from x left join ra using (id) left join rr using (id) left join ea using (id) left join er using (id))
    select id, change, ra::int as callers_added, rr::int as callers_removed, ea::int as callees_added, er::int as callees_removed from (select *, case when i0 is null then 'added' when i1 is null then 'removed' when m0 <> m1 then 'moved' when s0 <> s1 then 'signature'
        when ra + rr > 0 then 'callers' when ea + er > 0 then 'callees' end as change from y) where change is not null""")
def snapshot(spark, sf):
    old, new = snapshots(spark, sf)
    oe, ne = _snapshot_edges(spark, sf)
    return o.snapshot_diff(old, oe, new, ne)


@query("diff_snapshot_scope", SQL["diff_snapshot"].replace("from olds a full join news b on", "from (select * from olds where module in (3, 7)) a full join (select * from news where module in (3, 7)) b on"))
def snapshot_scope(spark, sf):
    old, new = snapshots(spark, sf)
    oe, ne = _snapshot_edges(spark, sf)
    return o.snapshot_diff(old, oe, new, ne, F.col("module").isin(3, 7))


@query("diff_edges", f"with {SNAP_EDGES} select src, dst, 'added' as change from (select * from ne except select * from oe) union all select src, dst, 'removed' from (select * from oe except select * from ne)")
def edge_delta(spark, sf):
    return o.edge_delta(*_snapshot_edges(spark, sf))


@query("delta_resolve", """with calls as (select l_orderkey * 10 + l_linenumber as call_id, p_type as callee_name, l_partkey as callee_id from lineitem join part on p_partkey = l_partkey),
    added as (select p_partkey as id, p_type as name from part where p_partkey % 400 = 1), removed as (select p_partkey as id from part where p_partkey % 3 = 0),
    new as (select call_id, 'new' as effect, a.id as symbol from calls join added a on a.name = callee_name), lost as (select call_id, 'lost' as effect, callee_id as symbol from calls where callee_id in (select id from removed))
    select * from new union all select * from lost union all select call_id, 'unresolved', 0 from lost where call_id not in (select call_id from new)""")
def delta_resolve(spark, sf):
    return _delta_resolve(spark, sf, read(spark, sf, "lineitem"))


def _delta_resolve(spark, sf, lines):
    part = read(spark, sf, "part")
    calls = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("p_type").alias("callee_name"), F.col("l_partkey").alias("callee_id"))
    added = part.where("p_partkey % 400 = 1").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return o.resolve_delta(added, part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")), calls)


@query("gc_unreferenced", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45) and o_orderdate < timestamp '1996-01-01'")
def gc(spark, sf):
    live = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.unreferenced(read(spark, sf, "orders"), live, "o_orderkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("cas_merge", "select a.doc_id, a.source, b.first_doc from documents a join (select sha256(text) as h, min(doc_id) as first_doc from documents where text is not null group by 1) b on sha256(a.text) = b.h")
def cas(spark, sf):
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return o.cas_merge(d.groupBy("hash").agg(F.min("doc_id").alias("first_doc")), d).select("doc_id", "source", "first_doc")


@query("chain_verify", """with r as (select conv_id % 10 as table_name, conv_id * 100 + turn as seq, turn = 3 as changed, turn = 1 and conv_id % 7 = 2 as gone from conversations),
    l as (select *, lag(gone, 1, false) over (partition by table_name order by seq) as cut from r)
    select table_name, count(*) as n, count(*) filter (where changed or cut) as broken, min(seq) filter (where changed or cut) as first_broken from l where not gone group by 1""")
def chain(spark, sf):
    """A log in which some payloads were changed and some rows deleted after they had been signed."""
    rows = read(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("table_name"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("text").alias("payload"), "turn", "conv_id")
    signed = o.chain(rows).where("not (turn = 1 and conv_id % 7 = 2)")
    return o.verify_chain(signed.withColumn("payload", F.when(F.col("turn") == 3, F.concat(F.coalesce("payload", F.lit("")), F.lit("!"))).otherwise(F.col("payload"))))


@query("stream_latest_wins", """with e as (select *, epoch_ms(ts) as ms from events), g as (select *, coalesce(ms - lag(ms) over (partition by user_id order by ms, ts, event_id::varchar) > 600000, true)::int as fresh from e),
    s as (select *, sum(fresh) over (partition by user_id order by ms, ts, event_id::varchar) as s from g), b as (select *, row_number() over (partition by user_id, s order by ms, ts, event_id::varchar) as nth from s)
    select user_id, count(*) as n, case when count(*) = 3 then 'number' else 'quiet' end as closed, arg_max(event_id, nth) as last_id from b group by user_id, s, (nth - 1) // 3""")
def latest_wins(spark, sf):
    """Batches of a user end before ten quiet minutes or with their third event; the last one wins."""
    from ..streaming import events as e

    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return e.latest_wins(rows, "user_id", "ts", 600_000, 3).select("user_id", "n", "closed", F.col("event_id").alias("last_id"))


@query("stream_two_phase_guard", """with e as (select event_id, user_id, event_type in ('click', 'view') as seen, event_id // 4000 * 10 + (event_id * 7919) % 5 as g from events),
    m as (select *, max(g) filter (where seen) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as top from e)
    select event_id, case when seen then case when top is null or g > top then 'accept' when g = top then 'duplicate' else 'stale' end when g = top then 'commit' else 'stale' end as verdict from m""")
def two_phase_guard(spark, sf):
    from ..streaming import events as e

    rows = read(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("click", "view"), "seen").otherwise("commit").alias("phase"), F.expr("event_id div 4000").alias("epoch"), F.expr("(event_id * 7919) % 5").alias("seq"))
    return e.two_phase_guard(rows, "user_id", "event_id").select("event_id", "verdict")


@query("stream_coalesce_batch", """with e as (select user_id, event_type, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, event_type as kind, event_id as last_id from e where n = 1""")
def coalesce_latest(spark, sf):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf, "events").withColumn("n", rank).where("n = 1").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("last_id"))


@query("stream_debounce_batch", """with e as (select ts, ts - lag(ts) over (order by ts, event_id) > interval 300 second as g from events), s as (select ts, sum(coalesce(g, true)::int) over (order by ts rows unbounded preceding) as k from e)
    select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by k""")
def debounce(spark, sf):
    from ..streaming.events import debounced

    return debounced(read(spark, sf, "events"), "ts", "300 seconds").select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("stream_hash_diff_batch", """with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
    select user_id, event_id, case when before is null then 'added' else 'modified' end as change from e where before is null or before <> event_type""")
def hash_diff(spark, sf):
    from ..streaming.events import hash_diff as diff

    return diff(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "change")


@query("stream_fold_batch", """with e as (select user_id as path, list(case event_type when 'click' then 'created' when 'view' then 'modified' when 'error' then 'removed' when 'purchase' then 'created' when 'login' then 'modified' end order by ts, event_id) as k
    from events where event_type in ('click', 'view', 'error', 'purchase', 'login') group by user_id)
    select path, list_reduce(k, lambda a, b: case when a = 'created' and b = 'modified' then 'created' when a = 'removed' and b = 'created' then 'modified' else b end) as kind, len(k)::int as n from e""")
def fold(spark, sf):
    from ..streaming.events import coalesce_batch

    rows = read(spark, sf, "events").select(F.col("user_id").alias("path"), "ts", "event_id", F.element_at(F.create_map(*[F.lit(x) for x in ("click", "created", "view", "modified", "error", "removed", "purchase", "created", "login", "modified")]), F.col("event_type")).alias("kind"))
    return coalesce_batch(rows.where("kind is not null"), "path", ["ts", "event_id"], "kind", "watcher")


@query("stream_generation_guard", """with e as (select event_id, user_id as session, (event_id * 7919) % 1000 as seq from events), m as (select *, max(seq) over (partition by session order by event_id rows between unbounded preceding and 1 preceding) as top from e)
    select event_id, case when top is null or seq > top then 'accept' when seq = top then 'duplicate' else 'stale' end as verdict from m""")
def guard(spark, sf):
    from ..streaming.events import generation_guard

    rows = read(spark, sf, "events").select("event_id", F.col("user_id").alias("session"), F.lit(0).alias("epoch"), ((F.col("event_id") * 7919) % 1000).alias("seq"))
    return generation_guard(rows, "session", "event_id").select("event_id", "verdict")


@query("delta_symbols", f"""with {SNAPSHOTS} select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change
    from olds a full join news b on a.id = b.id where a.id is null or b.id is null or a.module <> b.module or a.signature <> b.signature""")
def delta_symbols(spark, sf):
    old, new = [df.select("id", F.struct("module", "signature").alias("v")) for df in snapshots(spark, sf)]
    return o.diff(old, new, "id", "v").where("change != 'unchanged'").select("id", F.when(F.col("change") == "modified", "changed").otherwise(F.col("change")).alias("change"))


@query("hist_windowed", "select event_id from events where ts > (select max(ts) - interval 2 day from events)")
def windowed(spark, sf):
    from ..functions.scalars import window_seconds

    e = read(spark, sf, "events")
    last = e.agg((F.max("ts") - F.expr(f"make_dt_interval(0, 0, 0, {window_seconds('2d')})")).alias("cut"))
    return e.crossJoin(F.broadcast(last)).where("ts > cut").select("event_id")  # one row


@query("edit_revert_rate", "select c_nationkey, count(*) as edits, coalesce(round(count_if(c_acctbal < 0)::double / nullif(count_if(c_acctbal < 5000), 0), 4), 0)::double as revert_rate from customer group by 1")
def revert_rate(spark, sf):
    from ..operators.graph import ratio

    bal = F.col("c_acctbal")
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("edits"), ratio(F.count_if(bal < 0), F.count_if(bal < 5000)).alias("revert_rate"))
