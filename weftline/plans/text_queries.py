"""Text, similarity and vector queries over documents, benchmark, pages and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import similarity as s
from ..operators import text as t
from ..operators import vector as v
from ..operators.context import question_context
from ..operators.trigram import TrigramIndex
from .adapters import EDGES, edges, read
from .iterate import shared_folder

QUERIES, SQL = {}, {}
def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, sf):
    return read(spark, sf, "documents")


#: The languages of the test documents stand for programming languages.
AS_CODE = {"en": "python", "fr": "java", "de": "typescript", "es": "go"}
CODE_SQL = "(select doc_id, text, case lang when 'en' then 'python' when 'fr' then 'java' when 'de' then 'typescript' when 'es' then 'go' end as code from documents where text is not null)"


def coded(spark, sf):
    code = F.element_at(F.create_map(*[F.lit(x) for kv in AS_CODE.items() for x in kv]), F.col("lang"))
    return docs(spark, sf).where("text is not null").select("doc_id", "text", F.when(F.col("lang").isin(*AS_CODE), code).alias("code"))


def _count(pattern):
    return f"len(regexp_extract_all(text, '{pattern}'))"


COMPLEXITY_SQL = " + ".join(_count(p) for p in (
    r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bmatch\b", r"\bcase\b", r"\bcatch\b", r"\b&&\b", r"\b\|\|\b", r"\btry\b", r"\bexcept\b", r"\bfinally\b", r"\bwhen\b", r"\bguard\b",
))
COMPLEXITY_SQL = rf"""(1 + {COMPLEXITY_SQL} + case when code in ('rust', 'c', 'java', 'typescript', 'javascript', 'go') then {_count(r'\?\s*[^:]+\s*:')} when code = 'python' then {_count(r'\bfor\b.*\bin\b')} else 0 end)::bigint"""


@query("text_complexity", f"select doc_id, {COMPLEXITY_SQL} as complexity from {CODE_SQL}")
def complexity(spark, sf):
    return coded(spark, sf).select("doc_id", t.complexity(F.col("text"), F.col("code")).alias("complexity"))


@query("complexity_hotspots", f"select doc_id, {COMPLEXITY_SQL} as complexity from {CODE_SQL} order by complexity desc, doc_id limit 20")
def hotspots(spark, sf):
    return complexity(spark, sf).orderBy(F.desc("complexity"), "doc_id").limit(20)


ISSUES_SQL = rf"""rules(rule, severity, code, pattern) as (values
    ('todo_fixme', 'warn', null, '\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b'),
    ('hardcoded_path', 'warn', null, '"(?:src|docs|scripts|tests|target|\.cargo|\.git|/tmp/|/usr/|/etc/|C:\\|/home/)[/\w\-\.\\]*"'),
    ('hardcoded_url', 'info', null, '"https?://[^\s"]+"'), ('magic_number', 'info', null, '\b\d{{4,}}\b'),
    ('any_type', 'warn', 'typescript', ':\s*any\b|\bas\s+any\b'), ('console_log', 'info', 'typescript', 'console\.(log|error|warn|debug)\('),
    ('ts_ignore', 'warn', 'typescript', '@ts-ignore|@ts-nocheck'), ('non_null_assertion', 'warn', 'typescript', '\w!\s*[.\(\)]'),
    ('bare_except', 'danger', 'python', 'except\s*:'), ('print_debug', 'info', 'python', '\bprint\('), ('broad_except', 'warn', 'python', 'except\s+Exception\s*:'),
    ('mutable_default', 'warn', 'python', 'def\s+\w+\([^)]*=\s*(\[\]|\{{\}})'),
    ('nil_check_missing', 'warn', 'go', '\.([A-Z]\w*)\('), ('err_ignored', 'danger', 'go', '_\s*=\s*\w+\.\w+\('), ('fmt_print_debug', 'info', 'go', 'fmt\.Print(ln|f)?\('),
    ('panic_call', 'danger', 'go', '\bpanic\('), ('unsafe_import', 'warn', 'go', '"unsafe"'),
    ('print_stack_trace', 'warn', 'java', '\.printStackTrace\('), ('system_out_print', 'info', 'java', 'System\.out\.print(ln)?\('),
    ('empty_catch', 'warn', 'java', 'catch\s*\([^)]+\)\s*\{{[\s;]*\}}'), ('raw_type', 'warn', 'java', '\b(List|Map|Set|Collection|Iterator|Comparable)\s*[^<\w]'),
    ('magic_suppress', 'info', 'java', '@SuppressWarnings')),
    hits as (select doc_id, rule, severity, len(regexp_extract_all(text, pattern)) as occurrences from {CODE_SQL} d join rules r on r.code is null or r.code = d.code)"""


@query("text_issues", f"with {ISSUES_SQL} select doc_id, rule, severity, occurrences::int as occurrences from hits where occurrences > 0")
def issues(spark, sf):
    return t.issues(coded(spark, sf), "doc_id", "text", "code")


@query("issue_summary", f"""with {ISSUES_SQL}, x as (select * from hits where occurrences > 0) select rule, severity, count(*) as functions, sum(occurrences)::bigint as occurrences,
    round(count(*)::double / (select count(*) from documents), 4) as ratio from x group by rule, severity""")
def issue_summary(spark, sf):
    n = docs(spark, sf).agg(F.count("*").alias("total"))
    x = issues(spark, sf).groupBy("rule", "severity").agg(F.count("*").alias("functions"), F.sum("occurrences").alias("occurrences"))
    return x.crossJoin(F.broadcast(n)).select("rule", "severity", "functions", "occurrences", F.round(F.col("functions") / F.col("total"), 4).alias("ratio"))  # one row


@query("fts_search", "select doc_id, lang from documents where contains(lower(text), 'thand') and contains(lower(text), 'ering') order by lang, doc_id limit 50")
def fts(spark, sf):
    return t.search(docs(spark, sf), "thand a ering", ["text"], 50, "lang", "doc_id").select("doc_id", "lang")


@query("fts_short_query", "select doc_id from documents where contains(lower(text), 'ß') order by doc_id limit 30")
def fts_short(spark, sf):
    return t.search(docs(spark, sf), "ß", ["text", "source"], 30, "doc_id").select("doc_id")


@query("fts_index", "select doc_id from documents where contains(lower(text), 'thand') and contains(lower(text), 'ering')")
def fts_index(spark, sf):
    """The index is stored in two generations, and some texts are replaced by themselves."""
    rows = docs(spark, sf).where("text is not null").select("doc_id", "text")
    index = TrigramIndex(spark, f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}", buckets=32)
    index.add(rows.where("doc_id % 3 <> 0"), "doc_id", "text")
    index.add(rows.where("doc_id % 3 <> 1"), "doc_id", "text")
    return index.search("thand ering", rows, "doc_id", "text").select("doc_id")


@query("grep_lines", r"""select doc_id, line::int as line from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
    where regexp_matches(content, '(?i)^the') and regexp_matches(content, 'ing\.$') order by doc_id, line limit 5000""")
def grep(spark, sf):
    return t.grep(docs(spark, sf), "doc_id", "text", ["(?im)^the", r"(?m)ing\.$"]).select("doc_id", "line")


@query("grep_enclosing", r"""with m as (select doc_id as file, line::int as line from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
    where regexp_matches(content, '(?i)^the')), s as (select l_orderkey as file, l_linenumber as id, min(l_returnflag) as kind, l_linenumber as start_line, (l_linenumber + max(l_quantity) % 4)::bigint as end_line from lineitem group by l_orderkey, l_linenumber)
    select m.file, m.line, s.id as symbol, s.kind from m join s on s.file = m.file and m.line between s.start_line and s.end_line
    qualify row_number() over (partition by m.file, m.line order by s.end_line - s.start_line, s.start_line, s.id) = 1 and kind in ('A', 'R')""")
def grep_enclosing(spark, sf):
    matches = t.text_lines(docs(spark, sf).where("text is not null"), "doc_id", "text").where(F.col("content").rlike("(?i)^the")).select(F.col("doc_id").alias("file"), "line")
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("id")).agg(F.min("l_returnflag").alias("kind"), F.max("l_quantity").alias("q"))
    symbols = lines.select("file", "id", "kind", F.col("id").alias("start_line"), (F.col("id") + F.col("q") % 4).cast("long").alias("end_line"))
    return t.enclosing(matches, symbols, ["A", "R"]).select("file", "line", "symbol", "kind")


@query("file_slice", "select doc_id, line::int as line, content from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) where line between 2 and 3")
def file_slice(spark, sf):
    return t.text_lines(docs(spark, sf).where("text is not null"), "doc_id", "text").where("line between 2 and 3")


@query("keyword_fallback", "select distinct doc_id, 0.5::double as score from documents where contains(lower(text), 'worthless') or contains(lower(text), 'pathetic') order by doc_id limit 20")
def keywords(spark, sf):
    return t.keyword_search(docs(spark, sf), "worthless or pathetic", "doc_id", "text", 20)


@query("rag_budget", """with x as (select doc_id, length(text) as n, sum(length(text)) over (order by n_chars, doc_id) as total from documents where length(text) > 0)
    select doc_id, n, (select max(total) > 8000 from x) as truncated from x where total <= 8000""")
def rag(spark, sf):
    return t.budgeted(docs(spark, sf).select("doc_id", "n_chars", "text"), "text", ["n_chars", "doc_id"], 8000).select("doc_id", F.length("text").cast("long").alias("n"), "truncated")


@query("text_cross_layer", r"""with hits as (select doc_id, 'db' as layer, unnest(regexp_extract_all(text, p, 1)) as item from documents, (values ('(?i)\bFROM\s+(\w+)'), ('(?i)\bUPDATE\s+(\w+)'), ('(?i)\bINSERT\s+INTO\s+(\w+)'), ('(?i)\bDELETE\s+FROM\s+(\w+)')) r(p)
    union all select doc_id, 'config', unnest(regexp_extract_all(text, p, 1)) from documents, (values ('env::var\s*\(\s*[''"]([^''"]+)[''"]\s*\)'), ('config\.get\s*\(\s*[''"]([^''"]+)[''"]\s*\)')) r(p)
    union all select doc_id, 'api', 'http_method_annotation' from documents where regexp_matches(text, '(?i)#\[(?:get|post|put|delete|patch|head|options)\s*\(')
    union all select doc_id, 'api', 'route_decorator' from documents where regexp_matches(text, '(?i)@\w+\.(?:route|get|post|put|delete|patch)\s*\('))
    select distinct doc_id, layer, item from hits""")
def cross_layer(spark, sf):
    return t.cross_layer(docs(spark, sf), "doc_id", "text").distinct()


@query("text_extract", r"""with x as (select doc_id, 'secret' as kind, unnest(list_distinct(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1))) as name from documents
    union all select doc_id, 'address', unnest(list_distinct(regexp_extract_all(text, '\b([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\b', 1))) from documents) select * from x""")
def extract(spark, sf):
    return t.extract(docs(spark, sf), "doc_id", "text", {"secret": r'token = "([0-9a-f]+)"', "address": r"\b([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\b"})


@query("page_titles", r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<p>'))::int as paragraphs from pages")
def titles(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


GUARD_SQL = r"""with x as (select doc_id, text, rule, severity, p from documents, (values ('token', 'block', 'token = '), ('junk', 'warn', '[#$%&]{3}')) r(rule, severity, p) where text is not null),
    cut as (select doc_id, rule, severity, regexp_extract_all(text, p) as m, string_split_regex(text, p) as s from x),
    hits as (select doc_id, rule, severity, unnest(list_transform(range(1, len(m) + 1), lambda k: 1 + len(regexp_extract_all(array_to_string(s[1:k], '') || array_to_string(m[1:k - 1], ''), chr(10))))) as line from cut)"""
#: Rules of a caller's own.
OWN_RULES = (("token", "secrets", "block", "token = "), ("junk", "style", "warn", "[#$%&]{3}"))


@query("guard_scan", f"{GUARD_SQL} select doc_id, rule, severity, line::int as line from hits")
def guard(spark, sf):
    return t.guard(docs(spark, sf), "doc_id", "text", OWN_RULES).select("doc_id", "rule", "severity", "line")


@query("guard_builtin", r"""with rules(rule, severity, p) as (values ('GR-builtin-db-1', 'warn', '(?i)\bALTER\s+TABLE\b'), ('GR-builtin-db-2', 'block', '(?i)\bDROP\s+(?:TABLE|COLUMN)\b'),
    ('GR-builtin-api-1', 'block', '(?i)#\s*BREAKING\s+CHANGE'), ('GR-builtin-api-2', 'block', '(?i)//\s*REMOVED\s+PARAM'), ('GR-builtin-api-3', 'block', '(?i)//\s*REMOVED\s+FIELD')),
    code as (select p_partkey, chr(10) || repeat('x' || chr(10), p_size) || case p_partkey % 4 when 0 then 'alter  table t' when 1 then 'DROP' || chr(10) || 'COLUMN c; drop table u' when 2 then '# breaking change' else 'VARCHAR(' || p_size || ') -> VARCHAR(20)' end as text from part)
    select p_partkey, rule, severity, count(*)::int as n, min(p_size)::int + 2 as line from code join part using (p_partkey), rules, (select unnest(range(5)) as i) where i < len(regexp_extract_all(text, p)) group by all
    union all select p_partkey, 'GR-builtin-db-3', 'block', 1, p_size::int + 2 from part where p_partkey % 4 = 3 and p_size > 20""")
def guard_builtin(spark, sf):
    part, size = read(spark, sf, "part"), F.col("p_size").cast("string")
    kinds = [F.lit("alter  table t"), F.lit("DROP\nCOLUMN c; drop table u"), F.lit("# breaking change"), F.concat(F.lit("VARCHAR("), size, F.lit(") -> VARCHAR(20)"))]
    text = F.concat(F.lit("\n"), F.repeat(F.lit("x\n"), F.col("p_size")), F.get(F.array(*kinds), (F.col("p_partkey") % 4).cast("int")))
    found = t.guard(part.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.groupBy("p_partkey", "rule", "severity").agg(F.count("*").cast("int").alias("n"), F.min("line").alias("line"))


@query("guard_readiness", r"""with b as (select doc_id, text from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10)
    select doc_id, 'GR-builtin-inc-1' as rule, 'warn' as severity from b where not regexp_matches(text, '\b(?:try|catch|unwrap|expect)\b|\?|Result')
    union all select doc_id, 'GR-builtin-inc-2', 'info' from b where not regexp_matches(text, '\blog::|tracing::|println!|print!|eprintln!|warn!|info!|error!|debug!')
    union all select doc_id, 'GR-builtin-inc-3', 'warn' from b where (regexp_matches(text, '(?i)\b(?:INSERT|UPDATE|DELETE|CREATE|DROP)\b') or regexp_matches(text, '\.(?:write|save|push|insert|update|delete)\s*\('))
        and not regexp_matches(text, '(?i)\b(?:rollback|transaction|begin|undo|abort|commit)\b')""")
def guard_readiness(spark, sf):
    return t.readiness(docs(spark, sf).select("doc_id", "text"), ["doc_id"], "text")


@query("guard_decision", f"{GUARD_SQL} select doc_id, case when bool_or(severity = 'block') then 'block' else 'warn' end as decision from hits group by doc_id")
def decision(spark, sf):
    return t.decide(t.guard(docs(spark, sf), "doc_id", "text", OWN_RULES), "doc_id")


@query("content_hash_lookup", "select sha256(text) as hash, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1")
def content(spark, sf):
    return docs(spark, sf).where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("canonical_source", r"select doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g')) as hash from documents where text is not null")
def canonical(spark, sf):
    from ..sources.code import canonical_text

    return docs(spark, sf).where("text is not null").select("doc_id", F.sha2(canonical_text(F.col("text")), 256).alias("hash"))


def bodies(spark, sf, min_chars=0):
    rows = docs(spark, sf).where(f"length(text) > {min_chars}").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), s.token_hash(s.normalise(F.col("text"))).alias("token_hash"), "text")
    # The tokens are a column of their own: inside a lambda they would be split again for each shingle.
    rows = rows.withColumn("tokens", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return rows.withColumn("items", s.shingles(F.col("tokens"))).drop("text", "tokens")


@query("clone_t1", "select a, b from (select doc_id as b, min(doc_id) over (partition by text) as a from documents where text is not null) where a <> b")
def clone_t1(spark, sf):
    return s.stars(docs(spark, sf).where("text is not null").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], "doc_id")


NORMAL_SQL = r"""normals as (select doc_id as id, sha256(text) as ch, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?s)/\*.*?\*/', ' ', 'g'), '(?s)(#|//).*', ' ', 'g'), '"[^"\n]*"|''[^''\n]*''', ' ' || chr(1) || ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*', ' ' || chr(2) || ' ', 'g'), '[0-9]+(\.[0-9]+)?', ' ' || chr(3) || ' ', 'g'),
    '([^\s\x01-\x03])', ' \1 ', 'g'), chr(1), 'STR'), chr(2), 'ID'), chr(3), 'NUM'), '\s+', ' ', 'g')) as n from documents where length(text) > 0)"""


TYPE2_SQL = "firsts as (select substr(sha256(n), 1, 16) as th, ch, min(id) as b from normals group by n, ch), twos as (select a, b from (select b, min(b) over (partition by th) as a from firsts) where a <> b)"


@query("clone_t2", f"with {NORMAL_SQL}, {TYPE2_SQL} select a, b from twos")
def clone_t2(spark, sf):
    d = docs(spark, sf).where("length(text) > 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("ch"), s.token_hash(s.normalise(F.col("text"))).alias("th"))
    return s.stars(d.groupBy("ch", "th").agg(F.min("id").alias("id")), ["th"])


SETS_SQL = r"""words as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents where length(text) > 0),
    sets as (select doc_id, list_distinct(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(31))) end) as items from words),
    inv as (select doc_id, len(items) as n, unnest(items) as g from sets),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) as j from inv a join inv b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)"""


@query("clone_t3", f"""with {SETS_SQL}, classes as (select doc_id as b, min(doc_id) over (partition by list_sort(items)) as a from sets)
    select a, b, round(j, 4) as similarity from pairs where j >= 0.8 and j < 1 and a in (select a from classes) and b in (select a from classes)
    union all select a, b, 1.0::double from classes where a <> b""")
def clone_t3(spark, sf):
    found = s.similar_classes(bodies(spark, sf).select("id", "items"), 0.8)
    return found.select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("clone_groups", "select substr(sha256('1:' || sha256(text)), 1, 16) as group_hash, 1 as clone_type, count(*) as members, min(doc_id) as representative from documents where text is not null group by text having count(*) > 1")
def clone_groups(spark, sf):
    d = docs(spark, sf).where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return s.clone_groups(d, "content_hash", 1)


@query("clone_pairs", f"""with {SETS_SQL}, {NORMAL_SQL}, {TYPE2_SQL}, reps as (select min(id) as id from normals group by n),
    ones as (select a, b from (select id as b, min(id) over (partition by ch) as a from normals) where a <> b)
    select a, b, 1 as clone_type, 1.0::double as similarity from ones union all select a, b, 2, 1.0::double from twos
    union all select a, b, 3, round(j, 3) from pairs where j >= 0.8 and j < 1 and a in (select id from reps) and b in (select id from reps)""")
def clone_pairs(spark, sf):
    return s.clone_pairs(bodies(spark, sf), 0.8)


@query("clone_stats", "with x as (select sha256(text) as h, count(*) as n from documents where text is not null group by 1 having count(*) > 1) select sum(n * (n - 1) / 2)::bigint as pairs, sum(n)::bigint as files, count(*) as groups from x")
def clone_stats(spark, sf):
    x = docs(spark, sf).where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return x.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("n").alias("files"), F.count("*").alias("groups"))


@query("clone_lsh")
def lsh(spark, sf):
    return s.lsh_candidates(s.minhashed(bodies(spark, sf).select("id", "items")))


@query("shared_content", "with x as (select distinct sha256(text) as h, source from documents where text is not null) select a.source as a, b.source as b, count(*) as shared from x a join x b on a.h = b.h and a.source < b.source group by 1, 2")
def shared(spark, sf):
    return s.shared_content(docs(spark, sf).where("text is not null").select(F.sha2("text", 256).alias("hash"), F.col("source").alias("workspace")))


COS = "list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[])))"


@query("vec_topk", f"select a.vec_id, round({COS}, 6) as score from embeddings a, embeddings b where b.vec_id = 0 order by {COS} desc, a.vec_id limit 20")
def topk(spark, sf):
    rows = read(spark, sf, "embeddings")
    q = rows.where("vec_id = 0").first()["embedding"]
    return v.topk(rows, q, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("vec_similar", f"""with x as (select b.vec_id as query, a.vec_id as vec, round({COS}, 4) as score from embeddings a, embeddings b where b.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
    select query, vec, score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, vec) as rank from x where score >= 0.2) where rank <= 20""")
def similar(spark, sf):
    rows = read(spark, sf, "embeddings")
    return v.similar(rows, rows.where("vec_id % 50 = 0"), 20, 0.2)


@query("vec_missing", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def missing(spark, sf):
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return v.missing(docs(spark, sf).select("doc_id"), vectors, "doc_id")


@query("rag_context", f"""with {EDGES}, seeds as (select *, row_number() over (order by cos desc, seed) as rank from (select a.vec_id as seed, {COS} as cos from embeddings a, embeddings b where b.vec_id = 0) order by cos desc, seed limit 5),
    callers as (select *, row_number() over (partition by seed order by node) as n from (select distinct seed, rank, cos, src as node from seeds join edges on dst = seed where src <> dst)),
    callees as (select *, row_number() over (partition by seed order by node) as n from (select distinct seed, rank, cos, dst as node from seeds join edges on src = seed where src <> dst)),
    blocks as (select seed, rank, cos, seed as node, 0 as role from seeds union all select seed, rank, cos, node, 1 from callers where n <= 2 union all select seed, rank, cos, node, 2 from callees where n <= 1),
    once as (select * from blocks qualify row_number() over (partition by node order by rank, role) = 1),
    placed as (select *, row_number() over (order by rank, role, node) as place, sum(length(text)) over (order by rank, role, node) as total from once join documents on doc_id = node where length(text) > 0)
    select place::int as place, node, ['seed', 'caller', 'callee'][role + 1] as role, seed, round(cos, 6) as score, length(text)::bigint as n, (select max(total) > 40000 from placed) as truncated from placed where total <= 40000""")
def rag_context(spark, sf):
    """Documents stand for the texts of the parts of the same number, embeddings for their vectors."""
    vectors = read(spark, sf, "embeddings")
    question = vectors.where("vec_id = 0").first()["embedding"]
    found = question_context(vectors, question, docs(spark, sf).select(F.col("doc_id").alias("node"), "text"), edges(spark, sf), most=40_000)
    return found.select("place", "node", "role", "seed", F.round("score", 6).alias("score"), F.length("text").cast("long").alias("n"), "truncated")
