"""Registered queries of programs, script patterns, the store, streams and introspection, each with SQL that says the same."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.expr import Typed, json_number, over
from logloom.functions.match import match, prefilter
from logloom.lang.syntax import parse_expression
from logloom.operators import journal as J
from logloom.operators import programs as R
from logloom.plans import program as P
from logloom.plans.batch import detect
from logloom.plans.reaction import reaction
from logloom.registry import WITH, query, shared_folder
from logloom.sources import journals as S
from logloom.sources.segments import encode_segments, seek_segments
from logloom.sources.store import Conflict, JournalStore
from logloom.streaming.operators import Rule, counts, detect_stream, follow, replicate, sessions


# Query programs as columns
def orders_with_lines(spark: SparkSession, sf: str) -> DataFrame:
    o, li = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).drop("l_orderkey")


DOCUMENT = """
big = o_totalprice > 100000.0;
if (big) { print 'big' size; } else print 'small' size;
for (i, line in lines) { print i at, line.n n; if (line.qty > 25.0) print line.part part; }
if (big) { half = o_orderkey / 2; print half half; }
"""


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos FROM lineitem)
SELECT o_orderkey, '{"size":"' || CASE WHEN any_value(o_totalprice) > 100000 THEN 'big' ELSE 'small' END || '","line":[' || string_agg('{"at":' || pos || ',"n":' || l_linenumber || CASE WHEN l_quantity > 25 THEN ',"part":' || l_partkey ELSE '' END || '}', ',' ORDER BY pos)
|| ']' || CASE WHEN any_value(o_totalprice) > 100000 THEN ',"half":' || (o_orderkey // 2) ELSE '' END || '}' AS document FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def program_document(spark, sf):
    return P.run_documents(orders_with_lines(spark, sf), DOCUMENT, ["o_orderkey"])


@query("""SELECT o_orderkey, CAST(count(*) AS INT) AS n, sum(l_quantity) AS total, max(l_quantity) AS best, CAST(count(CASE WHEN l_quantity > 25 THEN 1 END) AS INT) AS large, count(*) > 3 AS many
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def program_totals(spark, sf):
    script = "n = 0; total = 0.0; best = 0.0; large = 0; for (x : lines) { n = n + 1; total = total + x.qty; if (x.qty > best) best = x.qty; large = large + (x.qty > 25.0 ? 1 : 0); } print n n, total total, best best, large large, lines.Count > 3 many;"
    return P.run_columns(orders_with_lines(spark, sf), script, ["o_orderkey"])


@query("""SELECT o_orderkey, 'error' AS severity, 'price of ' || o_orderkey AS message FROM orders WHERE NOT o_totalprice >= 2000
UNION ALL SELECT o_orderkey, 'warning', 'old' FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01'
UNION ALL SELECT o_orderkey, 'information', 'seen ' || o_orderstatus FROM orders""")
def program_diagnostics(spark, sf):
    script = "check(o_totalprice >= 2000.0) error 'price of ' + o_orderkey; if (o_orderstatus == 'F') { check(o_orderdate >= 01/01/1995) warning 'old'; } notify information 'seen ' + o_orderstatus;"
    return P.run_diagnostics(S.table(spark, sf, "orders"), script, ["o_orderkey"])


@query("""SELECT p_partkey, '{"key":' || p_partkey || ',"twice":' || 2 * p_size || CASE WHEN p_size > 40 THEN ',"large":true' ELSE '' END || '}' AS expose FROM part""")
def program_expose(spark, sf):
    return P.run_exposed(S.table(spark, sf, "part"), "expose p_partkey key, 2 * p_size as twice; if (p_size > 40) expose true large;", ["p_partkey"])


@query("SELECT p_partkey, p_size * 2 AS twice, p_size > 10 AS above FROM part WHERE p_size >= 5 AND NOT (p_size > 45)")
def guarded_command(spark, sf):
    df = S.table(spark, sf, "part")
    limit = {"limit": over(df).typed(parse_expression("5 + 5"))}  # an argument that is an expression
    check = "check(p_size >= 5) error 'small'; if (p_size > 45) { notify error 'large'; } notify warning 'w';"
    return P.run_guarded(df, check, "eval('x = p_size * 2;'); print x twice, p_size > limit above;", ["p_partkey"], parameters=limit)


@query("SELECT p_partkey, '<root>' || chr(10) || '  <name>' || p_name || '</name>' || chr(10) || CASE WHEN p_size > 20 THEN '  <size>' || p_size || '</size>' || chr(10) ELSE '' END || '</root>' || chr(10) AS document FROM part")
def program_xml(spark, sf):
    return P.run_documents(S.table(spark, sf, "part"), "print p_name name; { if (p_size > 20) print p_size size; }", ["p_partkey"], render="xml")


# Expressions
@query("""SELECT p_partkey, -p_size AS minus, +p_size AS plus, greatest(p_size, 10) AS least10, abs(p_size - 25) AS away, sqrt(p_size * p_size) AS root, CAST(3 AS INT) AS n, p_size AS head, list_contains([p_size, 1, 2], 2) AS has,
p_size || '' AS text, (p_size::DOUBLE + 0.5::DOUBLE)::VARCHAR AS half, p_size || '.0' AS json, p_size || '/' || p_name AS pair FROM part""")
def expression_forms(spark, sf):
    df = S.table(spark, sf, "part")
    c = over(df)
    pair = c.typed(parse_expression("Pair(p_size, p_name)"))
    return df.select(
        "p_partkey", c.column("-p_size").alias("minus"), c.column("+p_size").alias("plus"), c.column("Math.Max(p_size, 10)").alias("least10"), c.column("Math.Abs(p_size - 25)").alias("away"),
        c.column("Math.Sqrt(p_size * p_size)").alias("root"), c.column("{p_size, 1, 2}.Count").alias("n"), c.column("{p_size, 1, 2}[0]").alias("head"), c.column("{p_size, 1, 2}.Contains(2)").alias("has"),
        c.column("p_size + ''").alias("text"), c.column("(p_size + 0.5) + ''").alias("half"), json_number(Typed(F.col("p_size").cast("double"), "double")).alias("json"),
        F.concat_ws("/", pair.col["_1"].cast("string"), pair.col["_2"]).alias("pair"),
    )


@query("""SELECT vec_id, CAST((v[1] > 0)::INT + (v[2] > 0)::INT AS INT) AS up, CAST(3 AS INT) AS some, CAST(v[8] AS DOUBLE) AS last, CAST(v[2] AS DOUBLE) AS inner_ FROM (SELECT vec_id, embedding[1:8] AS v FROM embeddings)""")
def list_members(spark, sf):
    df = S.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v"), F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4)).alias("grid"))
    c = over(df)
    return df.select(
        "vec_id", c.column("{v[0] > 0.0 ? 1 : 0, v[1] > 0.0 ? 1 : 0}.Sum()").alias("up"), c.column("v.Skip(2).Take(3).Count").alias("some"),
        c.column("v.Last()").cast("double").alias("last"), c.column("grid[0, 1]").cast("double").alias("inner_"),
    )


@query("""SELECT n_nationkey, lpad(n_name, CAST(greatest(12, length(n_name)) AS INT), ' ') AS padded, substr(n_name, 1, 2) || '-' || substr(n_name, 3) AS cut, CAST(len(string_split(n_name, 'A')) AS INT) AS parts,
CAST(CASE WHEN contains(n_name, 'A') THEN length(n_name) - strpos(reverse(n_name), 'A') ELSE -1 END AS INT) AS last FROM nation""")
def text_members(spark, sf):
    df = S.table(spark, sf, "nation")
    c = over(df)
    return df.select("n_nationkey", c.column("n_name.PadLeft(12)").alias("padded"), c.column("n_name.Insert(2, '-')").alias("cut"), c.column("n_name.Split('A').Count").alias("parts"), c.column("n_name.LastIndexOf('A')").alias("last"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH AS later, CAST(dayofyear(o_orderdate) AS INT) AS day, o_orderdate > TIMESTAMP '1996-01-01' AS late FROM orders")
def now_is_the_entry(spark, sf):
    df = S.table(spark, sf, "orders")
    c = over(df, {"now": Typed(F.col("o_orderdate"), "datetime")})  # Now is when the entry was written, also on replay
    return df.select("o_orderkey", c.column("Now.AddMonths(2)").alias("later"), c.column("Now.DayOfYear").alias("day"), c.column("Now > 01/01/1996").alias("late"))


# Journals of scripts, run
def tally(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts alone carry what happens: each entry changes its actor's globals."""
    rows = S.user_entries(spark, sf)
    buy = F.concat(F.lit("n = n + 1; total = total + "), F.col("k"), F.lit("; last = 'purchase';"))
    other = F.concat(F.lit("n = n + 1; if (n > 5) { many = true; last = '"), F.col("member"), F.lit("'; } else last = 'early';"))
    return rows.select("actor", "entry_id", "occurred_at", F.when(F.col("member") == "purchase", buy).otherwise(other).alias("script"))


START = "n = 0; total = 0; last = ''; many = false;"


@query(f"""{WITH}, s AS (SELECT user_id, count(*) AS n, coalesce(sum(k) FILTER (WHERE member = 'purchase'), 0) AS total, arg_max(CASE WHEN member = 'purchase' THEN 'purchase' WHEN entry_id > 5 THEN member ELSE 'early' END, entry_id) AS last,
coalesce(bool_or(entry_id > 5 AND member <> 'purchase'), false) AS many FROM u GROUP BY user_id)
SELECT user_id::VARCHAR AS actor, 'n' AS symbol, 'int' AS static_type, n::VARCHAR AS value FROM s UNION ALL SELECT user_id::VARCHAR, 'total', 'int', total::VARCHAR FROM s
UNION ALL SELECT user_id::VARCHAR, 'last', 'string', last FROM s UNION ALL SELECT user_id::VARCHAR, 'many', 'bool', CASE WHEN many THEN 'True' ELSE 'False' END FROM s""")
def replay_symbols(spark, sf):
    return R.show_symbols(tally(spark, sf), setup=START).select("actor", "symbol", "static_type", "value")


@query(f"""{WITH} SELECT user_id::VARCHAR AS actor, entry_id, '{{"n":' || entry_id || CASE WHEN entry_id > 3 THEN ',"size":"many"' ELSE '' END || '}}' AS document, CAST(CASE WHEN entry_id < 6 THEN 0 ELSE 1 END AS INT) AS warnings, member = 'error' AS failed FROM u""")
def replay_documents(spark, sf):
    text = F.concat(F.lit("n = n + 1; print n n; if (n > 3) print 'many' size; check(n < 6) warning 'busy';"), F.when(F.col("member") == "error", F.lit(" nothing.Here();")).otherwise(F.lit("")))
    rows = S.user_entries(spark, sf).select("actor", "entry_id", "occurred_at", text.alias("script"))
    return R.run_entries(rows, setup="n = 0;").select("actor", "entry_id", "document", F.size("diagnostics").alias("warnings"), F.col("error").isNotNull().alias("failed"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """The first purchase of each user defines an action, later ones invoke it; signups change nothing."""
    e = S.user_entries(spark, sf)
    first = e.where("member = 'purchase'").groupBy("actor").agg(F.min("entry_id").alias("first"))
    rows = e.where("member IN ('purchase', 'signup')").join(first, "actor", "left")
    buys, begins = F.col("member") == "purchase", F.col("entry_id") == F.col("first")
    define = F.lit("define action 7 (p:int, q:double) as total = total + p; n = n + 1; half = n * q; end;")
    return rows.select(
        "actor", "entry_id", "occurred_at", F.when(~buys, F.lit("notify information 'hello';")).alias("script"), F.when(buys, F.lit(7)).alias("action_id"),
        F.when(buys & ~begins, F.concat(F.col("k"), F.lit(", 0.5"))).alias("arguments"), F.when(buys & begins, define).alias("define_text"),
    )


@query(f"""{WITH}, b AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY entry_id) AS r FROM u WHERE member = 'purchase')
SELECT user_id::VARCHAR AS actor, (count(*) - 1) AS n, CAST(coalesce(sum(k) FILTER (WHERE r > 1), 0) AS BIGINT) AS total FROM b GROUP BY user_id""")
def replay_actions(spark, sf):
    found = R.show_symbols(actions(spark, sf), setup="n = 0; total = 0; half = 0.0;").where("symbol IN ('n', 'total')")
    both = found.groupBy("actor").agg(*[F.max(F.when(F.col("symbol") == c, F.col("value").cast("long"))).alias(c) for c in ("n", "total")])
    return both.join(actions(spark, sf).where("define_text IS NOT NULL").select("actor"), "actor", "left_semi")


@query(f"""{WITH}, t AS (SELECT 'define action 7(p : int) as total = total + p * ' || (k % 5) || '; total.Add(' || (k % 5) || ', p); end;' AS canonical FROM e) SELECT canonical, count(*) AS n FROM t GROUP BY 1""")
def canonical_bodies(spark, sf):
    """Definitions that differ in spaces and comments only are one."""
    k, odd = F.col("k") % 5, F.col("entry_id") % 3
    space = F.when(odd == 0, F.lit("  ")).when(odd == 1, F.lit(" // no matter\n")).otherwise(F.lit("\n\t/* this */ "))
    text = F.concat(F.lit("define action 7 (p:int) as"), space, F.lit("total=total+p*"), k, F.lit(";"), space, F.lit("total . Add("), k, F.lit(",p) ;"), space, F.lit("end;"))
    return R.canonical(S.entries(spark, sf).select(text.alias("define_text")), "define_text").groupBy("canonical").agg(F.count("*").alias("n"))


def _in_words(text: str) -> str:
    """'let x' and 'add 5 to x' as scripts."""
    w = text.split()
    return f"{w[1]} = 0;" if w[0] == "let" else f"{w[3]} = {w[3]} + {w[1]};"


@query(f"{WITH} SELECT user_id::VARCHAR AS actor, CAST(sum(k) AS VARCHAR) AS value FROM e GROUP BY user_id")
def replay_notation(spark, sf):
    """Entries in another notation, which a function turns into scripts."""
    rows = S.user_entries(spark, sf).select("actor", "entry_id", "occurred_at", F.concat(F.lit("add "), F.col("k"), F.lit(" to total")).alias("script"))
    return R.show_symbols(rows, setup="let total", notation=_in_words).select("actor", "value")


# Patterns over scripts
def commands(spark: SparkSession, sf: str) -> DataFrame:
    """events as scripts of many forms, parsed to facts."""
    e, k = S.entries(spark, sf), F.col("k")
    text = (
        F.when(F.col("member") == "click", F.concat(F.lit("c = Cart("), k, F.lit(", 'x');")))
        .when(F.col("member") == "view", F.concat(F.lit("user_1.Page("), k, F.lit(").Show({1, 2}, -"), k % 7, F.lit(");")))
        .when(F.col("member") == "purchase", F.concat(F.lit("tell Bank("), k, F.lit(") Pay("), F.col("user_id"), F.lit(") id 'e"), F.col("entry_id"), F.lit("';")))
        .when(F.col("member") == "error", F.concat(F.lit("tell ack 'e"), k, F.lit("';")))
        .otherwise(F.concat(F.lit("user_1.Put(user_1.Inner("), k, F.lit("), total);")))
    )
    rows = e.withColumn("script", text).withColumn("actor", F.lit("")).drop("member")
    return S.parse_scripts(rows, types={"User": ["User"], "Cart": ["Cart"], "Bank": ["Bank"]}, prefixes={"user_": "User"})


@query(f"{WITH} SELECT entry_id FROM e WHERE member = 'click'")
def pattern_constructor(spark, sf):
    return match(commands(spark, sf), "Cart(_, $b:string)").select("entry_id")


@query(f"{WITH} SELECT entry_id, 'c' AS c FROM e WHERE member = 'click'")
def pattern_assignment(spark, sf):
    return match(commands(spark, sf), "c = Cart(_, _);").select("entry_id", "c")


@query(f"{WITH} SELECT entry_id, k AS n FROM e WHERE member = 'view'")
def pattern_chained(spark, sf):
    return match(commands(spark, sf), "[User].Page($n:int).Show({1, 2}, _)").select("entry_id", "n")


@query(f"{WITH} SELECT entry_id, k AS n FROM e WHERE member = 'signup'")
def pattern_nested(spark, sf):
    return match(commands(spark, sf), "[User].Put([User].Inner($n:int), _)").select("entry_id", "n")


@query(f"{WITH} SELECT entry_id, k AS n, 'e' || entry_id AS ident FROM e WHERE member = 'purchase'")
def pattern_tell(spark, sf):
    return match(commands(spark, sf), "tell Bank($n:int) Pay(_) id $ident:string").select("entry_id", "n", "ident")


@query(f"{WITH} SELECT entry_id, 'e' || k AS ident FROM e WHERE member = 'error'")
def pattern_ack(spark, sf):
    return match(commands(spark, sf), "tell ack $ident").select("entry_id", "ident")


@query(f"{WITH} SELECT entry_id, k FROM e WHERE member = 'click' AND k > 4 AND k < 20")
def pattern_several(spark, sf):
    r = reaction("both").seek("[_:User].click(_, _, $k:int) where $k > 4", "[User].click(_, _, $j:int) where $j < 20")
    return detect(r, S.journal(spark, sf)).select(F.col("trigger_entry_id").alias("entry_id"), F.col("j").alias("k"))


@query(f"{WITH} SELECT entry_id FROM e WHERE member = 'click' AND contains(user_id::VARCHAR, '1')")
def pattern_prefilter(spark, sf):
    return S.scripts(spark, sf).where(prefilter(F.col("script"), ["USER_", "1", ".Click("])).select("entry_id")


@query(f"{WITH} SELECT member, CAST(2 AS INT) AS arity, count(*) AS n FROM e GROUP BY member")
def show_class(spark, sf):
    parsed = S.parse_scripts(S.scripts(spark, sf).drop("member"), types={"User": ["User"]}, prefixes={"user_": "User"})
    return R.show_class(parsed, "USER").select("member", "arity", "n")


@query(f"{WITH} SELECT member, CAST(0 AS INT) AS at, 'int' AS type, k::VARCHAR AS value, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT member, 1, 'string', member, count(*) FROM e GROUP BY ALL")
def parameter_pools(spark, sf):
    parsed = S.parse_scripts(S.scripts(spark, sf).drop("member"), types={"User": ["User"]}, prefixes={"user_": "User"})
    return R.parameter_pools(parsed).select("member", "at", "type", "value", "n")


@query(f"{WITH} SELECT CAST(7 AS INT) AS action_id, max(entry_id) AS define_entry_id FROM (SELECT user_id, min(entry_id) AS entry_id FROM u WHERE member = 'purchase' GROUP BY user_id)")
def show_action(spark, sf):
    return R.show_actions(actions(spark, sf), 7).select("action_id", "define_entry_id")


@query(f"{WITH} SELECT entry_id, 'SCRIPT' AS kind, 'user_' || user_id || '.' || member || '(' || k || ', ''' || member || ''');' AS script, occurred_at AS at FROM e WHERE entry_id = 77")
def show_entry(spark, sf):
    rows = S.scripts(spark, sf).select("entry_id", "occurred_at", "script", F.lit(None).cast("int").alias("action_id"))
    return R.show_entry(rows, 77).select("entry_id", "kind", "script", "at")


@query(f"""{WITH}, f AS (SELECT member AS reaction_id, count(*) AS n FROM e WHERE k > 90 GROUP BY 1), c AS (SELECT member AS reaction_id, k % 3 AS lvl, max(entry_id) AS d, min(entry_id) AS c FROM e WHERE member <> 'error' GROUP BY ALL)
SELECT m.reaction_id, coalesce(f.n, 0) AS match_count, coalesce(string_agg(lvl || ':' || d || ':' || c.c, ',' ORDER BY lvl), '') AS seeks FROM (SELECT DISTINCT member AS reaction_id FROM e) m LEFT JOIN f USING (reaction_id) LEFT JOIN c USING (reaction_id) GROUP BY m.reaction_id, f.n""")
def show_reactions(spark, sf):
    e = S.entries(spark, sf).withColumnRenamed("member", "reaction_id")
    points = e.where("reaction_id <> 'error'").groupBy("reaction_id", (F.col("k") % 3).alias("seek_level")).agg(F.max("entry_id").alias("detected"), F.min("entry_id").alias("confirmed"))
    shown = R.show_reactions(e.select("reaction_id").distinct(), points, e.where("k > 90"))
    seek = lambda s: F.concat_ws(":", s["seek_level"].cast("string"), s["detected"].cast("string"), s["confirmed"].cast("string"))
    return shown.select("reaction_id", "match_count", F.array_join(F.transform("seeks", seek), ",").alias("seeks"))


@query(f"""{WITH}, p AS (SELECT a.entry_id AS l0, b.entry_id AS x, row_number() OVER (PARTITION BY a.entry_id ORDER BY b.entry_id) AS r FROM e a JOIN e b ON a.member = 'signup' AND b.member = 'error' AND a.user_id = b.user_id AND b.entry_id > a.entry_id AND b.entry_id - a.entry_id <= 3000)
SELECT l0, string_agg(x::VARCHAR, ',' ORDER BY x) AS ids FROM p WHERE r <= 2 GROUP BY l0 HAVING count(*) = 2""")
def accumulate_name(spark, sf):
    r = reaction("errors").seek("[User].signup($u1:long, _, _)").then_final_seek("[User].error($u2:long, _, _)").where("u1 == u2").many(2).within(3000).accumulate("found")
    return detect(replace(r, stale_after=None), S.journal(spark, sf)).select(F.element_at("levels", 1).alias("l0"), F.array_join("found", ",").alias("ids"))


# The store
def script_rows(spark: SparkSession, sf: str) -> DataFrame:
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return S.scripts(spark, sf).select("entry_id", "occurred_at", F.lit("SCRIPT").alias("kind"), "script", none("action_id", "int"), none("arguments", "string"), none("define_text", "string"), "expose", "actor")


def new_store(spark: SparkSession) -> JournalStore:
    return JournalStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def filled_store(spark: SparkSession, sf: str, cut: str = "true") -> JournalStore:
    store = new_store(spark)
    store.append(script_rows(spark, sf).where(cut))
    return store


@query(f"{WITH} SELECT entry_id, 'SCRIPT' AS kind FROM e WHERE NOT (member = 'view' AND k > 50) UNION ALL SELECT max(entry_id) + 1, 'DEFINE' FROM e UNION ALL SELECT max(entry_id) + 2, 'INVOCATION' FROM e")
def store_elide(spark, sf):
    """Append, a definition with its first call as one commit, marks with their checkpoint; a stale writer is refused."""
    store = filled_store(spark, sf)
    at = store.last_id()
    rows = [(at + 1, None, "DEFINE", None, 9, None, "define action 9 () as x = 1; end;", None, ""), (at + 2, None, "INVOCATION", None, 9, "", None, None, "")]
    kinds = "entry_id long, occurred_at timestamp_ntz, kind string, script string, action_id int, arguments string, define_text string, expose string, actor string"
    pair = spark.createDataFrame(rows, kinds).withColumn("occurred_at", F.lit("2024-03-01").cast("timestamp_ntz"))
    store.append_define_and_call(pair.where("kind = 'DEFINE'"), pair.where("kind = 'INVOCATION'"))
    marks = S.entries(spark, sf).where("member = 'view' AND k > 50").select("entry_id", F.lit("r").alias("reaction_id"))
    points = lambda n: spark.createDataFrame([("r", 0, n, n)], "reaction_id string, seek_level int, detected long, confirmed long")
    store.elide(marks, checkpoint=points(5))
    try:
        store.elide(marks.limit(0), checkpoint=points(9), expected=points(4))
        raise AssertionError("a stale checkpoint was taken")
    except Conflict:
        return store.scan().select("entry_id", "kind")


@query(f"{WITH} SELECT entry_id FROM e WHERE NOT (member = 'view' AND k > 50) OR entry_id = (SELECT max(entry_id) FROM e)")
def store_distill(spark, sf):
    """A destination must have confirmed; then elided entries go for good, and the last one stays."""
    store = filled_store(spark, sf)
    store.register("lake")
    store.elide(S.entries(spark, sf).where("member = 'view' AND k > 50").select("entry_id", F.lit("r").alias("reaction_id")))
    store.confirm("lake", store.last_id())
    store.distill()
    return store.scan(raw=True).select("entry_id")


@query(f"{WITH} SELECT 'a' AS destination, max(entry_id) AS last_confirmed FROM e UNION ALL SELECT 'b', max(entry_id) FROM e WHERE entry_id <= 400")
def store_destinations(spark, sf):
    """Watermarks start at the head; to register twice changes nothing; sync delivers what is behind and raises the watermark."""
    store = filled_store(spark, sf, "entry_id <= 400")
    first = [store.register("a"), store.register("a"), store.register("b"), store.register("gone")]
    if first != [True, False, True, True]:
        raise AssertionError(first)
    store.deregister("gone")
    store.append(script_rows(spark, sf).where("entry_id > 400"))
    store.sync("a", lambda rows: rows.write.format("noop").mode("overwrite").save())
    return store.read("destination").select("destination", "last_confirmed")


@query(f"{WITH} SELECT 'key ' || entry_id AS idempotency_key, CAST(1 AS BIGINT) AS n FROM e WHERE member = 'error'")
def store_outbox(spark, sf):
    """Messages are recorded once for each key and sent once; a second relay finds nothing."""
    store, at = new_store(spark), f"{shared_folder(spark)}/sent-{uuid.uuid4().hex}"
    box = S.entries(spark, sf).where("member = 'error'").select(
        F.col("entry_id").alias("anchor_entry_id"), F.lit("mail").alias("destination"), F.col("member").alias("payload"),
        F.concat(F.lit("key "), F.col("entry_id")).alias("idempotency_key"), F.col("entry_id").alias("trigger_entry_id"),
    )
    for _ in range(2):
        store.record_outbox(box)
        store.dispatch(lambda rows: rows.write.mode("append").parquet(at))
    return spark.read.parquet(at).groupBy("idempotency_key").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT entry_id FROM e WHERE entry_id <= 5000 AND NOT (member = 'view' AND k > 50)")
def store_shadow(spark, sf):
    store = filled_store(spark, sf)
    store.elide(S.entries(spark, sf).where("member = 'view' AND k > 50").select("entry_id", F.lit("r").alias("reaction_id")))
    return store.shadow(f"{store.root}-shadow", 5000).scan().select("entry_id")


@query(f"{WITH} SELECT DISTINCT a.entry_id FROM e a JOIN e b ON b.user_id = a.user_id AND b.entry_id > a.entry_id AND b.entry_id - a.entry_id <= 400 AND a.member = 'view' AND b.member = 'purchase' AND a.k > 5 AND a.k <= 50")
def would_skip(spark, sf):
    """What a reaction would elide beyond what is elided already, without a commit."""
    store = filled_store(spark, sf)
    store.elide(S.entries(spark, sf).where("k > 50").select("entry_id", F.lit("old").alias("reaction_id")))
    r = reaction("view-buy").seek("[_:User].view($u1:long, _, $k1:int)").then_seek("[_:User].purchase($u2:long, _, _)").where("u1 == u2 && k1 > 5").within(400)
    return store.would_skip(J.elide(detect(r, S.journal(spark, sf)), "r", (0,))).select("entry_id")


@query(f"{WITH} SELECT entry_id, k AS size, 'n' || user_id AS who FROM e WHERE member = 'click' AND entry_id <= 6000 AND entry_id > 100")
def store_playbill(spark, sf):
    """Typed audit rows: read by their schema, without those whose entry is gone or archived."""
    store = filled_store(spark, sf, "entry_id <= 6000")
    params = F.to_json(F.struct(F.col("k").alias("size"), F.concat(F.lit("n"), F.col("user_id")).alias("who")))
    store.record_playbill("click", "size int, who string", S.entries(spark, sf).where("member = 'click'").select("entry_id", params.alias("params")))
    store.distill_playbill()
    store.archive_playbill(100, f"{store.root}-archive")
    return store.read_playbill("click")


@query(f"{WITH} SELECT entry_id FROM e WHERE entry_id > 5000")
def segment_seek(spark, sf):
    """Only the segments that can hold entries behind an id are decoded."""
    return seek_segments(encode_segments(script_rows(spark, sf), segment_bytes=1 << 14), 5000).select("entry_id")


@query("SELECT c_mktsegment AS destination, coalesce(max(CASE WHEN c_acctbal < 0 THEN c_custkey + 1 END), max(c_custkey)) AS entry_id FROM customer GROUP BY 1")
def keyed_upsert(spark, sf):
    c = S.table(spark, sf, "customer")
    old = c.groupBy(F.col("c_mktsegment").alias("destination")).agg(F.max("c_custkey").alias("entry_id"))
    new = c.where("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("destination")).agg((F.max("c_custkey") + 1).alias("entry_id"))
    return J.upsert(old, new, ["destination"], "entry_id")


@query("SELECT c_nationkey AS destination, min(c_custkey) AS entry_id FROM customer GROUP BY 1")
def insert_or_ignore(spark, sf):
    c = S.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("destination")).agg(F.min("c_custkey").alias("entry_id"), F.max("c_custkey").alias("last"))
    return J.upsert(c.select("destination", "entry_id"), c.select("destination", F.col("last").alias("entry_id")), ["destination"])


@query(f"{WITH} SELECT t.entry_id, c.entry_id IS NOT NULL AS caused FROM e t LEFT JOIN e c ON c.entry_id = t.entry_id - t.k AND c.member = 'view' WHERE t.member = 'error'")
def causation_check(spark, sf):
    """A message names the entry that caused it; the receiver takes it only if that entry is there and passes a check."""
    e = S.entries(spark, sf)
    tells = e.where("member = 'error'").select("entry_id", (F.col("entry_id") - F.col("k")).alias("cause_id"))
    return J.causation(tells, e, F.col("member") == "view").select("entry_id", "caused")


# Streams
def _run_stream(spark: SparkSession, rows: DataFrame, build) -> DataFrame:
    """What a streaming query over rows writes, from an empty checkpoint to the end of what is there."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    out = build(spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in"))
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _closed(rows: DataFrame) -> DataFrame:
    """rows and one far behind them in time, which closes all windows before it; times as instants, as watermarks want."""
    last = rows.limit(1).withColumn("occurred_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    return rows.unionByName(last).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


@query(f"{WITH}, w AS (SELECT member, time_bucket(INTERVAL 3 HOUR, occurred_at) - d * INTERVAL 3 HOUR AS start FROM e, (VALUES (0), (1)) x(d)) SELECT start, member, count(*) AS n FROM w GROUP BY ALL")
def stream_hopping(spark, sf):
    found = _run_stream(spark, _closed(S.entries(spark, sf).select("occurred_at", "member")), lambda s: counts(s, "6 hours", "3 hours"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "member", "n").where("start < '2029-01-01'")


@query(f"""{WITH}, g AS (SELECT user_id, occurred_at, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY user_id ORDER BY entry_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS cut FROM e),
s AS (SELECT user_id, occurred_at, sum(cut) OVER (PARTITION BY user_id ORDER BY occurred_at) AS lap FROM g) SELECT user_id::VARCHAR AS actor, min(occurred_at) AS start, count(*) AS n FROM s GROUP BY user_id, lap""")
def stream_sessions(spark, sf):
    found = _run_stream(spark, _closed(S.user_entries(spark, sf).select("occurred_at", "actor")), lambda s: sessions(s, "4 hours"))
    return found.select("actor", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n").where("start < '2029-01-01'")


@query(f"{WITH} SELECT entry_id, user_id FROM e")
def stream_replicate(spark, sf):
    """A copy kept by a stream: each micro-batch is written under its own number, so a repeat overwrites itself."""
    root = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    S.entries(spark, sf).select("entry_id", "user_id").repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("entry_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    replicate(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/part{n}"), f"{root}/check").awaitTermination()
    return spark.read.schema("entry_id long, user_id long").parquet(f"{root}/out/*")


@query(f"{WITH} SELECT 'buys' AS rule, entry_id, k::VARCHAR AS what FROM e WHERE member = 'purchase' UNION ALL SELECT 'faults', entry_id, member FROM e WHERE member = 'error' AND k > 50")
def follower_rules(spark, sf):
    """Rules called with what they match of each micro-batch of a journal."""
    root = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    S.journal(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")

    def keep(name, what):
        return lambda rows, n: rows.select(F.lit(name).alias("rule"), "entry_id", what.cast("string").alias("what")).write.mode("overwrite").parquet(f"{root}/out/{name}-{n}")

    rules = [Rule("buys", "[User].purchase(_, _, $k2:int)", keep("buys", F.col("k2"))), Rule("faults", "[User].error(_, _, $k2:int) where $k2 > 50", keep("faults", F.col("member")))]
    follow(stream, rules, f"{root}/check").awaitTermination()
    return spark.read.schema("rule string, entry_id long, what string").parquet(f"{root}/out/*")


@query(f"{WITH} SELECT user_id::VARCHAR AS actor, entry_id, k::VARCHAR AS n FROM u WHERE member = 'purchase' AND k > 3")
def stream_tell(spark, sf):
    """Messages, assignments and exposed values match in streams as they do in batches."""
    rows = S.user_entries(spark, sf).where("member = 'purchase'").drop("member")
    rows = rows.withColumn("script", F.concat(F.lit("tell Bank("), F.col("k"), F.lit(") Pay(1) id 'x'; v = 5;")))
    parsed = S.parse_scripts(rows, types={"Bank": ["Bank"]}).select("actor", "entry_id", "occurred_at", "calls", "expose")
    r = reaction("pay").seek("tell Bank($n:int) Pay(_) ... v = 5; expose $e:int k; where $n > 3")
    found = _run_stream(spark, parsed, lambda s: detect_stream(r, s))
    return found.select("actor", F.col("trigger_entry_id").alias("entry_id"), F.regexp_extract("bindings", r"(?:^|;)n=(\d+)", 1).alias("n"))
