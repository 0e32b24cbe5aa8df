"""Interval, cascade, suffix, rule and look-ahead joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from .adapters import ENTITIES, entities, read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _intervals(spark, sf):
    return entities(spark, sf).select("module", "id", "start_line", "end_line")


def _points(spark, sf):
    e = read(spark, sf, "lineitem").select((F.col("l_partkey") + 3).alias("line")).distinct()
    modules = read(spark, sf, "part").select(F.col("p_brand").alias("module")).distinct()
    return e.crossJoin(F.broadcast(modules))  # brands: a handful


POINTS = "points as (select distinct l_partkey + 3 as line, module from lineitem, (select distinct p_brand as module from part))"


@query("stab_narrowest", f"with {ENTITIES}, {POINTS} select module, line, arg_min(id, [end_line - start_line, start_line, id]) as id from points join entities using (module) where line between start_line and end_line group by module, line")
def stab(spark, sf):
    return j.stab_narrowest(_points(spark, sf), _intervals(spark, sf), ["module"])


@query("stab_first", f"with {ENTITIES}, {POINTS} select module, line, arg_min(id, [start_line, id]) as id from points join entities using (module) where line between start_line and end_line group by module, line")
def first(spark, sf):
    return j.stab_first(_points(spark, sf), _intervals(spark, sf), ["module"])


@query("interval_overlap", f"""with {ENTITIES}, hunks as (select p_brand as module, p_partkey as hunk, p_partkey as from_line, p_partkey + 7 as to_line from part)
    select module, hunk, id from hunks join entities using (module) where start_line <= to_line and end_line >= from_line""")
def overlap(spark, sf):
    return _overlap(spark, sf, read(spark, sf, "part"))


def _overlap(spark, sf, part):
    hunks = part.select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("hunk"), F.col("p_partkey").alias("from_line"), (F.col("p_partkey") + 7).alias("to_line"))
    return j.overlaps(hunks, _intervals(spark, sf), ["module"]).select("module", "hunk", "id")


@query("lookahead_defects", """with v as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as n from events),
    c as (select * from v where event_type <> 'error'), f as (select * from v where event_type = 'error')
    select f.user_id, f.event_id as finding, min(v.event_id) as change_event_id from f join v on v.user_id = f.user_id and v.n between f.n - 3 and f.n - 1 group by all""")
def lookahead(spark, sf):
    e = read(spark, sf, "events")
    finds = e.where("event_type = 'error'").select("user_id", "event_id", F.col("event_id").alias("finding"))
    return j.lookahead(e, finds, "user_id", "event_id", 3)


@query("resolve_cascade", f"""with {ENTITIES}, calls as (select l_orderkey, l_linenumber, p_brand as module, 'Brand' || (l_suppkey % 3)::varchar || '::' || l_partkey::varchar as q,
        (select min(p_name) from part) as shared, p_name as name, p_type as kind from lineitem join part on p_partkey = (l_partkey + l_suppkey) % 50),
    s1 as (select module, name, min(id) as id from entities where id % 2 = 0 group by all having count(*) = 1),
    s2 as (select name, min(id) as id from entities where id % 3 = 0 group by name having count(*) = 1),
    s3 as (select module, kind, min(id) as id from entities where id % 5 = 0 group by all)
    select l_orderkey, l_linenumber, coalesce(s1.id, s2.id, s3.id, 0) as callee_id, case when s1.id is not null then 'exact' when s2.id is not null then 'unique'
        when s3.id is not null then 'same_file' else 'unresolved' end as method
    from calls c left join s1 on s1.module = c.module and s1.name = c.name left join s2 on s2.name = c.name left join s3 on s3.module = c.module and s3.kind = c.kind""")
def cascade(spark, sf):
    return _cascade(spark, sf, read(spark, sf, "lineitem"))


def _cascade(spark, sf, lines):
    e = entities(spark, sf)
    calls = lines.join(read(spark, sf, "part"), F.expr("p_partkey = (l_partkey + l_suppkey) % 50"))
    calls = calls.select("l_orderkey", "l_linenumber", F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    found = j.cascade(
        calls,
        [
            ("exact", j.unique_by(e.where("id % 2 = 0"), ["module", "name"]), ["module", "name"]),
            ("unique", j.unique_by(e.where("id % 3 = 0"), ["name"]), ["name"]),
            ("same_file", j.least_by(e.where("id % 5 = 0"), ["module", "kind"]), ["module", "kind"]),
        ],
    )
    return found.select("l_orderkey", "l_linenumber", "callee_id", "method")


@query("suffix_match", """with f as (select p_partkey as id, 'src/' || p_brand || '/' || p_type || '/' || p_partkey::varchar as file from part),
    p as (select case when p_partkey % 2 = 0 then p_type || '/' || p_partkey::varchar else 'root/src/' || p_brand || '/' || p_type || '/' || p_partkey::varchar end as path from part)
    select path, min(id) as id from p join f on ends_with('/' || path, '/' || file) or ends_with('/' || file, '/' || path) group by path""")
def suffix(spark, sf):
    part = read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    files = part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.lit("src"), "p_brand", "p_type", key).alias("file"))
    paths = part.select(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("/", "p_type", key)).otherwise(F.concat_ws("/", F.lit("root/src"), "p_brand", "p_type", key)).alias("path"))
    return j.suffix_match(paths, files)


@query("owner_last_rule", """with r(idx, pattern, owner) as (values (1, '', 'everyone'), (2, '[02468]$', 'even'), (3, '1[0-9]$', 'teens'), (4, '99$', 'last'))
    select s_suppkey, s_name, arg_max(owner, idx) as owner from supplier, r where regexp_matches(s_name, pattern) group by all""")
def owner(spark, sf):
    rules = spark.createDataFrame([(1, "", "everyone"), (2, "[02468]$", "even"), (3, "1[0-9]$", "teens"), (4, "99$", "last")], "idx int, pattern string, owner string")
    return j.last_rule(read(spark, sf, "supplier").select("s_suppkey", "s_name"), rules, "s_name", "owner")


@query("call_noise_filter", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 10)")
def noise(spark, sf):
    stop = read(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(stop, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("ignore_rules", """select page_id, case when regexp_matches(p, '(^|/)keep\\.html(/|$)') then false when regexp_matches(p, '(^|/)[^/]*\\.html(/|$)') then true
    when regexp_matches(p, '^[^/]*/fr(/|$)') then true else false end as ignored from (select page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) as p from pages)""")
def ignore(spark, sf):
    path = F.expr("split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1)")
    return j.is_ignored(read(spark, sf, "pages").select("page_id", path.alias("path")), ["# comment", "*/fr", "*.html", "!keep.html"]).select("page_id", "ignored")
