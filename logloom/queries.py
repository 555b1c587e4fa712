"""The registered queries of the journal operators, each with SQL that says the same."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.expr import Typed, over, text
from logloom.functions.match import match
from logloom.functions.render import find_alias, to_json, to_list, to_xml
from logloom.operators import journal as J
from logloom.plans.batch import accept_increasing, bindings_digest, detect
from logloom.plans.reaction import Reaction, reaction
from logloom.registry import WITH, E, query, shared_folder
from logloom.sources import journals as S
from logloom.sources.segments import decode_segments, encode_segments
from logloom.streaming.operators import counts, detect_stream, sessions

# Scans
@query(f"{WITH} SELECT entry_id, user_id, member FROM e WHERE entry_id > 5000")
def scan_after(spark: SparkSession, sf: str) -> DataFrame:
    return J.scan(S.entries(spark, sf), 5000).select("entry_id", "user_id", "member")


@query(f"{WITH} SELECT count(*) AS n FROM e WHERE entry_id > 5000 AND NOT (member = 'error' AND k = 3)")
def count_after(spark, sf):
    rows = S.entries(spark, sf)
    return J.scan(rows, 5000, rows.where("member = 'error' AND k = 3")).agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'O' AND o_orderstatus = 'P' THEN 'SCRIPT' WHEN o_orderstatus = 'F' THEN 'DEFINE' ELSE 'INVOCATION' END AS kind FROM orders) GROUP BY kind")
def classify_entries(spark, sf):
    o, status = S.table(spark, sf, "orders"), F.col("o_orderstatus")
    rows = o.select(F.when(status.isin("P", "F"), "x").alias("script"), F.when(status.isin("F", "O"), 1).alias("action_id"))
    return J.classify(rows).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT e.entry_id, x.k AS k FROM e LEFT JOIN (SELECT entry_id, k FROM e WHERE k % 2 = 0) x USING (entry_id)")
def expose_join(spark, sf):
    rows = S.entries(spark, sf)
    side = rows.where("k % 2 = 0").select("entry_id", "expose")
    return J.with_expose(rows.select("entry_id"), side).select("entry_id", F.get_json_object("expose", "$.k").cast("int").alias("k"))


@query(f"{WITH} SELECT entry_id, occurred_at FROM e WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-09'")
def archive_range(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return J.archive(S.entries(spark, sf), day("2024-01-05"), day("2024-01-09")).select("entry_id", "occurred_at")


@query(f"{WITH} SELECT entry_id FROM e WHERE NOT (occurred_at <= TIMESTAMP '2024-01-15' AND member = 'view')")
def trim_elided(spark, sf):
    rows = S.entries(spark, sf)
    return J.trim(rows, rows.where("member = 'view'"), F.lit("2024-01-15").cast("timestamp_ntz")).select("entry_id")


@query(f"""{WITH}, last AS (SELECT user_id, max(occurred_at) AS t FROM e GROUP BY user_id),
days AS (SELECT date_diff('day', CAST(t AS DATE), DATE '2024-02-01') AS age, count(*) AS n FROM last GROUP BY 1),
a AS (SELECT *, 100 * n < 8 * sum(n) OVER (ORDER BY age) AS low FROM days),
b AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (ORDER BY age) AS island FROM a),
c AS (SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY age) AS streak FROM b)
SELECT CAST(age AS INT) AS age, n FROM c WHERE age <= coalesce((SELECT min(age) FROM c WHERE streak >= 2), 1000000)""")
def preload_actors(spark, sf):
    last = S.entries(spark, sf).groupBy("user_id").agg(F.max("occurred_at").alias("t"))
    days = last.groupBy(F.date_diff(F.lit("2024-02-01").cast("date"), F.col("t").cast("date")).alias("age")).agg(F.count("*").alias("n"))
    return J.recent_days(days, 8, 2)


# Expressions
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey // (l_suppkey + 1) AS BIGINT) AS whole, round(l_quantity * l_extendedprice, 4) AS gross,
l_linenumber + 1 AS nxt, CASE WHEN CAST(l_shipdate AS TIME) = TIME '00:00:00' THEN strftime(l_shipdate, '%m/%d/%Y') ELSE strftime(l_shipdate, '%m/%d/%Y %H:%M:%S') END AS shipped FROM lineitem""")
def project_print(spark, sf):
    df = S.table(spark, sf, "lineitem")
    c = over(df)
    shipped = text(Typed(F.col("l_shipdate"), "datetime"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.column("l_partkey / (l_suppkey + 1)").alias("whole"), F.round(c.column("l_quantity * l_extendedprice"), 4).alias("gross"), c.column("l_linenumber + 1").alias("nxt"), shipped.alias("shipped"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice < 1500 THEN 'big' ELSE CASE WHEN p_size = 1 THEN 'one' ELSE 'other' END END AS label FROM part")
def ternary_case(spark, sf):
    df = S.table(spark, sf, "part")
    return df.select("p_partkey", over(df).column("(p_size > 25 && p_retailprice < 1500) ? 'big' : p_size == 1 ? 'one' : 'other'").alias("label"))


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS INT) AS whole, CAST(p_size AS DOUBLE) AS real, CAST(p_size AS VARCHAR) AS name, CAST(CAST(p_size AS DECIMAL(28,10)) AS DOUBLE) AS exact FROM part")
def cast_matrix(spark, sf):
    df = S.table(spark, sf, "part")
    c = over(df)
    return df.select("p_partkey", c.column("(int) p_retailprice").alias("whole"), c.column("(double) p_size").alias("real"), c.column("(string) p_size").alias("name"), c.column("(decimal) p_size").cast("double").alias("exact"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[3] AS DOUBLE) AS third FROM embeddings")
def list_ops(spark, sf):
    df = S.table(spark, sf, "embeddings")
    c = over(df)
    return df.select("vec_id", c.column("embedding.Count").alias("n"), c.column("embedding[0]").cast("double").alias("first"), c.column("embedding[2]").cast("double").alias("third"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS due, o_orderdate - INTERVAL 2 HOUR AS before, CAST(epoch(o_orderdate - TIMESTAMP '1995-01-01') AS BIGINT) AS since FROM orders")
def temporal_arith(spark, sf):
    df = S.table(spark, sf, "orders")
    c = over(df)
    since = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - 788918400
    return df.select("o_orderkey", c.column("o_orderdate + time.Days(3)").alias("due"), c.column("o_orderdate - time.Hours(2)").alias("before"), since.alias("since"))


@query("""SELECT o_orderkey, 'error' AS severity, 'price' AS message FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT o_orderkey, 'warning', 'status' FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)""")
def check_violations(spark, sf):
    df = S.table(spark, sf, "orders")
    c = over(df)
    return J.check_rows(df, [(c.column("o_totalprice >= 2000"), "error", "price"), (c.column("o_orderstatus == 'F' || o_totalprice > 100000"), "warning", "status")], ["o_orderkey"])


@query("SELECT o_orderkey, i, l_linenumber, l_partkey FROM (SELECT o_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def for_nested_doc(spark, sf):
    o, li = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select("o_orderkey", F.posexplode("lines").alias("i", "x")).select("o_orderkey", "i", "x.l_linenumber", "x.l_partkey")


@query("SELECT n_nationkey, n_name || '/' || lower(n_name) || '/' || length(n_name) AS label, substr(n_name, 1, 3) AS head, contains(n_name, 'AN') AS has FROM nation")
def string_members(spark, sf):
    df = S.table(spark, sf, "nation")
    c = over(df)
    return df.select("n_nationkey", c.column("n_name + '/' + n_name.ToLower() + '/' + n_name.Length").alias("label"), c.column("n_name.Substring(0, 3)").alias("head"), c.column("n_name.Contains('AN')").alias("has"))


@query("SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(19,9)) * 1.5 AS DOUBLE) AS scaled, CAST(CAST(s_acctbal AS DECIMAL(28,10)) + 0.25 AS DOUBLE) AS more FROM supplier")
def decimal_promotion(spark, sf):
    df = S.table(spark, sf, "supplier")
    c = over(df)
    return df.select("s_suppkey", c.column("s_acctbal * 1.5m").cast("double").alias("scaled"), c.column("s_acctbal + 0.25m").cast("double").alias("more"))


# Patterns
@query(f"{WITH} SELECT entry_id, user_id AS u, value AS v FROM e WHERE member = 'purchase' AND k = 7")
def pattern_single(spark, sf):
    return match(S.journal(spark, sf), "[_:User].purchase($u:long, $v:double, 7)").select("entry_id", "u", "v")


@query(f"{WITH} SELECT entry_id, CASE WHEN member = 'purchase' THEN 'buy' ELSE 'fail' END AS branch, k FROM e WHERE member IN ('purchase', 'error') AND k > 4")
def pattern_guarded(spark, sf):
    found = match(S.journal(spark, sf), "[User].purchase(_, _, $k:int) as 'buy' || [User].error(_, _, $k:int) as 'fail' where $k > 4")
    return found.select("entry_id", F.col("_matchedbranch").alias("branch"), "k")


@query("""SELECT conv_id + 1 AS entry_id, min(u) AS n FROM (SELECT a.conv_id, length(a.text) AS u, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS r FROM conversations a
WHERE a.role = 'user' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.role = 'user' AND c.turn > b.turn))) WHERE r = 1 GROUP BY conv_id""")
def pattern_sequence_in_entry(spark, sf):
    return match(S.conversation_journal(spark, sf), "[Chat].user(_, $n:int) ... [Chat].assistant(_, _) [Chat].user(_, _)").select("entry_id", "n")


@query(f"{WITH} SELECT entry_id, k FROM e WHERE k > 5")
def pattern_expose(spark, sf):
    return match(S.journal(spark, sf), "expose $k:int k; [User] where $k > 5").select("entry_id", "k")


@query(f"{WITH} SELECT entry_id, user_id AS u FROM e WHERE member = 'signup' ORDER BY entry_id DESC LIMIT 32")
def find_pattern_top32(spark, sf):
    return match(S.journal(spark, sf), "[User].signup($u:long, _, _)").orderBy(F.col("entry_id").desc()).limit(32).select("entry_id", "u")


@query(f"{WITH} SELECT entry_id, user_id, k FROM e WHERE member = 'click' AND k < 3")
def pattern_on_scripts(spark, sf):
    rows = S.scripts(spark, sf).where(F.lower("script").contains("click"))
    parsed = S.parse_scripts(rows, types={"User": ["User", "Account"]}, prefixes={"user_": "User"})
    return match(parsed, "[Account].click($kk:int, 'click') where $kk < 3").select("entry_id", "user_id", F.col("kk").alias("k"))


# Sequences
def flat(matches: DataFrame, *names: str) -> DataFrame:
    """levels as columns l0, l1, ... and the trigger."""
    return matches.select(*[F.element_at("levels", i + 1).alias(f"l{i}") for i in range(len([n for n in names if n.startswith("l")]))], "trigger_entry_id", *[n for n in names if not n.startswith("l")])


def view_buy(entries: int | None = None, time: timedelta | None = None) -> Reaction:
    r = reaction("view-buy").seek("[_:User].view($u1:long, _, $k1:int)").then_seek("[_:User].purchase($u2:long, _, _)").where("u1 == u2 && k1 > 5")
    r = r.within(entries) if entries else r
    return r.within(time) if time else r


PAIR = "FROM e a JOIN e b ON b.user_id = a.user_id AND b.entry_id > a.entry_id AND a.member = 'view' AND b.member = 'purchase' AND a.k > 5"


@query(f"{WITH} SELECT a.entry_id AS l0, b.entry_id AS l1, b.entry_id AS trigger_entry_id, a.user_id AS u1 {PAIR}")
def seek_chain2(spark, sf):
    return flat(detect(view_buy(), S.journal(spark, sf)), "l0", "l1", "u1")


@query(f"""{WITH} SELECT a.entry_id AS l0, b.entry_id AS l1, c.entry_id AS l2, c.entry_id AS trigger_entry_id {PAIR} AND b.entry_id - a.entry_id <= 2000
JOIN e c ON c.member = 'error' AND c.user_id = a.user_id AND c.entry_id > b.entry_id AND c.entry_id - b.entry_id <= 2000 AND c.k <> a.k""")
def seek_chain3(spark, sf):
    r = view_buy(2000).then_seek("[_:User].error($u3:long, _, $k3:int)").where("u3 == u1 && k3 != k1").within(2000)
    return flat(detect(r, S.journal(spark, sf)), "l0", "l1", "l2")


@query(f"""{WITH} SELECT a.entry_id AS l0, b.entry_id AS l1, b.entry_id AS trigger_entry_id, a.k AS k1 FROM e a JOIN e b ON a.member = 'signup' AND b.member = 'error'
AND b.entry_id > a.entry_id AND b.entry_id - a.entry_id <= 3 AND b.value > a.value""")
def chain_within_entries(spark, sf):
    r = reaction("near").seek("[User].signup(_, $v1:double, $k1:int)").then_seek("[User].error(_, $v2:double, _)").where("v2 > v1").within(3)
    return flat(detect(r, S.journal(spark, sf)), "l0", "l1", "k1")


@query(f"{WITH} SELECT a.entry_id AS l0, b.entry_id AS l1, b.entry_id AS trigger_entry_id, a.user_id AS u1, a.k AS k1 {PAIR} AND b.occurred_at - a.occurred_at <= INTERVAL 12 HOUR")
def chain_within_time(spark, sf):
    return flat(detect(view_buy(time=timedelta(hours=12)), S.journal(spark, sf)), "l0", "l1", "u1", "k1")


@query(f"""{WITH} SELECT a.entry_id AS l0, b.entry_id AS l1, b.entry_id AS trigger_entry_id, 'user_' || a.user_id AS who FROM e a JOIN e b ON a.member = 'signup' AND b.member = 'click'
AND a.user_id = b.user_id AND b.entry_id > a.entry_id AND b.entry_id - a.entry_id <= 500""")
def chain_name_unify(spark, sf):
    r = reaction("same-receiver").seek("[who:User].signup(_, _, _)").then_seek("[who:User].click(_, _, _)").within(500)
    return flat(detect(r, S.journal(spark, sf)), "l0", "l1", "who")


# Quantifiers
def after_signup(n: int, entries: int) -> Reaction:
    return reaction("errors").seek("[User].signup($u1:long, _, _)").then_final_seek("[User].error($u2:long, _, $ke:int)").where("u1 == u2").many(n).within(entries)


def _many_sql(n: int, entries: int) -> str:
    return f"""{WITH}, p AS (SELECT a.entry_id AS l0, b.entry_id AS x, b.k, row_number() OVER (PARTITION BY a.entry_id ORDER BY b.entry_id) AS r FROM e a JOIN e b ON a.member = 'signup' AND b.member = 'error'
AND a.user_id = b.user_id AND b.entry_id > a.entry_id AND b.entry_id - a.entry_id <= {entries})
SELECT l0, min(x) AS l1, max(x) AS trigger_entry_id, CAST(arg_min(k, x) AS INT) AS ke, string_agg(x::VARCHAR, ',' ORDER BY x) AS ids FROM p WHERE r <= {n} GROUP BY l0 HAVING count(*) = {n}"""


def _with_ids(matches: DataFrame, *names: str) -> DataFrame:
    ids = F.array_join(F.slice("chain", 2, F.size("chain") - 1), ",")
    return matches.select(F.element_at("levels", 1).alias("l0"), F.element_at("levels", 2).alias("l1"), "trigger_entry_id", *names, ids.alias("ids"))


@query(_many_sql(1, 900))
def many_first(spark, sf):
    return _with_ids(detect(after_signup(1, 900), S.journal(spark, sf)), "ke")


@query(_many_sql(3, 3000))
def many_at_least(spark, sf):
    return _with_ids(detect(replace(after_signup(3, 3000), stale_after=None), S.journal(spark, sf)), "ke")


@query(f"""{WITH}, x AS (SELECT user_id, entry_id, member, max(CASE WHEN member = 'click' THEN entry_id END) OVER w AS last, count(CASE WHEN member = 'click' THEN 1 END) OVER w AS n,
min(CASE WHEN member = 'click' THEN entry_id END) OVER w AS first FROM u WINDOW w AS (PARTITION BY user_id ORDER BY entry_id))
SELECT user_id::VARCHAR AS actor, first AS l0, entry_id AS l1, n FROM x WHERE member = 'purchase' AND n >= 2 AND entry_id - last <= 2""")
def many_then_within(spark, sf):
    r = reaction("clicks").seek("[User].click(_, _, _)").many(2).then_seek("[User].purchase(_, _, _)").within(2)
    m = detect(r, S.user_journal(spark, sf))
    return m.select("actor", F.element_at("levels", 1).alias("l0"), F.element_at("levels", 2).alias("l1"), (F.size("chain") - 1).cast("long").alias("n"))


def exact(n: int) -> Reaction:
    return reaction("exact").seek("[User].purchase(_, _, _)").then_final_seek("[User].error(_, _, _)").exactly(n).within(5)


def _exact_sql(n: int) -> str:
    return f"""{WITH}, c AS (SELECT a.user_id, a.entry_id AS l0, count(b.entry_id) AS n, min(b.entry_id) AS f FROM u a LEFT JOIN u b ON b.user_id = a.user_id AND b.member = 'error' AND b.entry_id > a.entry_id AND b.entry_id <= a.entry_id + 5
WHERE a.member = 'purchase' GROUP BY ALL)
SELECT user_id::VARCHAR AS actor, l0, coalesce(f, l0) AS l1, l0 + 6 AS trigger_entry_id FROM c WHERE n = {n} AND EXISTS (SELECT 1 FROM u d WHERE d.user_id = c.user_id AND d.entry_id = l0 + 6)"""


def _exact(spark, sf, n):
    return detect(exact(n), S.user_journal(spark, sf)).select("actor", F.element_at("levels", 1).alias("l0"), F.element_at("levels", 2).alias("l1"), "trigger_entry_id")


@query(_exact_sql(0))
def none_within(spark, sf):
    return _exact(spark, sf, 0)


@query(_exact_sql(1))
def one_within(spark, sf):
    return _exact(spark, sf, 1)


@query(_exact_sql(2))
def exactly_within(spark, sf):
    return _exact(spark, sf, 2)


@query(f"""{WITH}, p AS (SELECT * FROM u a WHERE member = 'purchase' AND NOT EXISTS (SELECT 1 FROM u b WHERE b.user_id = a.user_id AND b.member = 'error' AND b.entry_id > a.entry_id AND b.occurred_at - a.occurred_at <= INTERVAL 1 DAY)),
q AS (SELECT p.user_id, p.entry_id AS l0, p.occurred_at AS t0, min(d.entry_id) AS closing FROM p JOIN u d ON d.user_id = p.user_id AND d.occurred_at - p.occurred_at > INTERVAL 1 DAY GROUP BY ALL)
SELECT q.user_id::VARCHAR AS actor, l0, v.entry_id AS l2, v.entry_id AS trigger_entry_id FROM q JOIN u v ON v.user_id = q.user_id AND v.member = 'view' AND v.entry_id >= closing AND v.occurred_at - t0 <= INTERVAL 2 DAY""")
def exact_mid_chain(spark, sf):
    r = reaction("calm").seek("[User].purchase(_, _, _)").then_seek("[User].error(_, _, _)").none().within(timedelta(days=1)).then_seek("[User].view(_, _, _)").within(timedelta(days=2))
    return detect(r, S.user_journal(spark, sf)).select("actor", F.element_at("levels", 1).alias("l0"), F.element_at("levels", 3).alias("l2"), "trigger_entry_id")


@query(f"""{WITH}, r AS (SELECT entry_id, CASE WHEN entry_id - lag(entry_id) OVER (ORDER BY entry_id) > 150 THEN 1 ELSE 0 END AS g FROM e WHERE member = 'error' AND k = 3 AND value > 50),
s AS (SELECT entry_id, sum(g) OVER (ORDER BY entry_id) AS lap FROM r) SELECT min(entry_id) AS trigger_entry_id FROM s GROUP BY lap""")
def stale_window(spark, sf):
    r = reaction("idle").seek("[User].error(_, $v:double, 3)").where("v > 50").many()
    return detect(replace(r, stale_after=150), S.journal(spark, sf)).select("trigger_entry_id")


# Coverage
def _anchors(spark, sf, key_columns):
    rows = S.user_entries(spark, sf)
    return rows.where("member = 'purchase'").select("actor", "entry_id", "occurred_at", *key_columns)


def _legs(spark, sf):
    return S.user_entries(spark, sf).where("member <> 'purchase'").select("actor", "entry_id", "occurred_at", F.col("member").alias("m"), (F.col("k") % 2).alias("p"))


def covering(spark, sf, text_: str, aged: timedelta | None = None) -> DataFrame:
    arrays = [F.array(F.lit("click"), F.lit("view")).alias("ms"), F.array(F.lit(0), F.lit(1)).alias("ps")]
    r = reaction("cover").seek(source=_anchors(spark, sf, arrays)).then_final_seek(source=_legs(spark, sf)).many().within(12).cover(text_)
    r = r.aged(aged) if aged else r
    return detect(r, S.user_journal(spark, sf)).select("actor", F.element_at("levels", 1).alias("l0"), "trigger_entry_id", F.array_join("chain", ",").alias("chain"))


def _cover_sql(pairs: str, n: int, tail: str = "SELECT user_id::VARCHAR AS actor, l0, t AS trigger_entry_id, l0 || ',' || ids AS chain FROM d") -> str:
    return f"""{WITH}, m AS (SELECT a.user_id, a.entry_id AS l0, b.member, b.k % 2 AS p, min(b.entry_id) AS x FROM u a JOIN u b ON b.user_id = a.user_id AND b.entry_id > a.entry_id AND b.entry_id <= a.entry_id + 12
AND a.member = 'purchase' AND (b.member, b.k % 2) IN ({pairs}) GROUP BY ALL),
d AS (SELECT user_id, l0, max(x) AS t, string_agg(x::VARCHAR, ',' ORDER BY x) AS ids FROM m GROUP BY ALL HAVING count(*) = {n}) {tail}"""


@query(_cover_sql("('click', 0), ('click', 1), ('view', 0), ('view', 1)", 4))
def coverage_cross(spark, sf):
    return covering(spark, sf, "(m, p) in $ms × $ps")


@query(_cover_sql("('click', 0), ('view', 1)", 2))
def coverage_zip(spark, sf):
    return covering(spark, sf, "(m, p) in ($ms, $ps)")


@query(_cover_sql("('click', 0), ('view', 1)", 2, """, f AS (SELECT d.*, (SELECT min(c.entry_id) FROM u c, u z WHERE c.user_id = d.user_id AND z.user_id = d.user_id AND z.entry_id = d.t AND c.occurred_at - z.occurred_at >= INTERVAL 6 HOUR) AS fired FROM d)
SELECT user_id::VARCHAR AS actor, l0, fired AS trigger_entry_id, l0 || ',' || ids AS chain FROM f WHERE fired IS NOT NULL"""))
def coverage_aged(spark, sf):
    return covering(spark, sf, "(m, p) in ($ms, $ps)", timedelta(hours=6))


# Planes
NEAR = f"(SELECT a.entry_id AS l0, b.entry_id AS l1, a.user_id AS u1, a.k AS k1 {PAIR} AND b.entry_id - a.entry_id <= 400)"


@query(f"{WITH} SELECT entry_id FROM e WHERE entry_id NOT IN (SELECT l0 FROM {NEAR} UNION SELECT l1 FROM {NEAR})")
def elide_chain(spark, sf):
    j = S.journal(spark, sf)
    return J.scan(j, 0, J.elide(detect(view_buy(400), j), "r")).select("entry_id")


@query(f"{WITH} SELECT DISTINCT l0 AS entry_id, 'r' AS reaction_id FROM {NEAR}")
def elide_selected_seek(spark, sf):
    return J.elide(detect(view_buy(400), S.journal(spark, sf)), "r", (0,))


@query(f"""{WITH}, m AS (SELECT *, max(row(l0, l1)) OVER (PARTITION BY u1 ORDER BY l1, l0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {NEAR})
SELECT l0, l1, u1 FROM m WHERE b IS NULL OR row(l0, l1) > b""")
def lexicographic_dedup(spark, sf):
    m = detect(view_buy(400), S.journal(spark, sf)).withColumn("l0", F.element_at("levels", 1))
    return accept_increasing(m, ["trigger_entry_id", "l0"], ["u1"]).select("l0", F.element_at("levels", 2).alias("l1"), "u1")


@query(f"{WITH} SELECT entry_id FROM e WHERE member NOT IN ('view', 'error') OR entry_id = (SELECT max(entry_id) FROM e)")
def distill_keep_last(spark, sf):
    rows = S.entries(spark, sf)
    return J.distill(rows, rows.where("member IN ('view', 'error')")).select("entry_id")


DESTINATIONS = [("a", 300), ("b", 500), ("c", 120)]


def _destinations(spark):
    return spark.createDataFrame(DESTINATIONS, "destination string, last_confirmed long")


@query("SELECT n, bool_and(c >= n) AS allowed FROM (VALUES (300), (500), (120)) d(c), (VALUES (100), (200)) x(n) GROUP BY n")
def distill_guard(spark, sf):
    out = None
    for n in (100, 200):
        row = J.may_distill(_destinations(spark), F.lit(n)).select(F.lit(n).alias("n"), "allowed")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{WITH} SELECT DISTINCT x AS entry_id, 'lake' AS destination FROM (SELECT l0 AS x FROM {NEAR} UNION SELECT l1 FROM {NEAR}) WHERE x NOT IN (SELECT entry_id FROM e WHERE value > 90)")
def materialize_markers(spark, sf):
    m = detect(view_buy(400), S.journal(spark, sf))
    known = S.entries(spark, sf).where("value > 90").select("entry_id", F.lit("lake").alias("destination"))
    return J.mark(m, "r", "lake", known).select("entry_id", "destination")


@query(f"{WITH} SELECT d AS destination, entry_id FROM e JOIN (VALUES ('a', 300), ('b', 700), ('c', 120)) x(d, c) ON entry_id > c")
def mirror_sync(spark, sf):
    confirmed = J.confirm(_destinations(spark), spark.createDataFrame([("b", 700), ("a", 10)], "destination string, entry_id long"))
    return J.unread(S.entries(spark, sf).select("entry_id"), confirmed).select("destination", "entry_id")


@query(f"{WITH} SELECT l0 AS anchor_entry_id, 'r:' || l0 || ':1' AS idempotency_key, 'user ' || u1 AS payload, min(l1) AS trigger_entry_id FROM {NEAR} GROUP BY ALL")
def outbox_record(spark, sf):
    m = detect(view_buy(400), S.journal(spark, sf))
    return J.outbox(m, "r", "mail", F.concat(F.lit("user "), F.col("u1"))).select("anchor_entry_id", "idempotency_key", "payload", "trigger_entry_id")


@query(f"{WITH} SELECT DISTINCT 'r:' || l0 || ':1' AS idempotency_key FROM {NEAR} WHERE k1 <= 50")
def outbox_pending(spark, sf):
    box = J.outbox(detect(view_buy(400), S.journal(spark, sf)), "r", "mail", F.col("k1").cast("string"))
    return J.pending(box, box.where("int(payload) > 50")).select("idempotency_key")


@query(f"{WITH}, o AS (SELECT entry_id FROM e WHERE member = 'view' AND k > 5 EXCEPT SELECT l0 FROM {NEAR}) SELECT (SELECT max(entry_id) FROM e) AS high_water, least((SELECT max(entry_id) FROM e), coalesce((SELECT min(entry_id) - 1 FROM o), (SELECT max(entry_id) FROM e))) AS closed_frontier")
def closed_frontier(spark, sf):
    j = S.journal(spark, sf)
    nodes = match(j, "[_:User].view(_, _, $k:int) where $k > 5").select("actor", F.array("entry_id").alias("levels"))
    return J.closed_frontier(nodes, detect(view_buy(400), j), j.agg(F.max("entry_id").alias("high_water")))


@query(f"{WITH} SELECT l0, l1, substr(sha256('k1|int|' || k1 || ';u1|bigint|' || u1 || ';'), 1, 16) AS digest FROM {NEAR}")
def bindings_hash(spark, sf):
    m = detect(view_buy(400), S.journal(spark, sf))
    return m.select(F.element_at("levels", 1).alias("l0"), F.element_at("levels", 2).alias("l1"), bindings_digest({"u1": F.col("u1"), "k1": F.col("k1")}).alias("digest"))


# Programs
@query(f"{WITH} SELECT 'user_' || user_id || '.' || member || '(?, ?);' AS shape, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 10")
def promotion_counts(spark, sf):
    return S.scripts(spark, sf).groupBy(J.shape(F.col("script")).alias("shape")).agg(F.count("*").alias("n")).where("n > 10")


@query(f"""{WITH}, s AS (SELECT entry_id, k, member, row_number() OVER (PARTITION BY user_id, member ORDER BY entry_id) AS sighting FROM e)
SELECT entry_id, sighting, CASE WHEN sighting <= 10 THEN 'SCRIPT' WHEN sighting = 11 THEN 'DEFINE' ELSE 'INVOCATION' END AS kind, CASE WHEN sighting > 10 THEN k || ',''' || member || '''' END AS args FROM s""")
def promotion_cut(spark, sf):
    return J.promote(S.scripts(spark, sf)).select("entry_id", "sighting", "kind", "args")


@query("SELECT o_orderpriority AS name, min(o_orderkey) AS entry_id, arg_min(o_orderstatus, o_orderkey) AS body, count(DISTINCT o_orderstatus) > 1 AS drift FROM orders GROUP BY 1")
def upgrade_once(spark, sf):
    o = S.table(spark, sf, "orders")
    return J.upgrades(o.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("body")))


@query(f"{WITH}, d AS (SELECT user_id, entry_id AS define_id, k FROM e WHERE member = 'signup') SELECT e.entry_id, max(define_id) AS define_id FROM e JOIN d ON d.user_id = e.user_id AND define_id < e.entry_id WHERE e.member = 'click' GROUP BY e.entry_id")
def define_invoke(spark, sf):
    e = S.entries(spark, sf)
    d = e.where("member = 'signup'").select(F.col("user_id").alias("action_id"), "entry_id", F.col("k").alias("define_text"))
    return J.invocations(d, e.where("member = 'click'").select("entry_id", F.col("user_id").alias("action_id"))).select("entry_id", "define_id")


@query(f"{WITH} SELECT user_id, member, max(entry_id) AS entry_id, arg_max(value, entry_id) AS value FROM e GROUP BY ALL")
def state_fold_last(spark, sf):
    return J.last_values(S.entries(spark, sf), ["user_id", "member"])


@query(f"""{WITH} SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN member = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS total, arg_max(member, entry_id) AS last FROM e GROUP BY user_id""")
def state_fold_ordered(spark, sf):
    def step(s, r):
        return {"n": s["n"] + 1, "total": s["total"] + (r["k"] if r["member"] == "purchase" else 0), "last": r["member"]}

    return J.fold(S.entries(spark, sf).select("user_id", "entry_id", "member", "k"), ["user_id"], step, {"n": 0, "total": 0, "last": None}, "user_id long, n long, total long, last string")


@query(f"""{WITH} SELECT 0 AS level, count(*) AS n FROM e WHERE member = 'view' AND k > 5 UNION ALL SELECT 1, count(*) FROM {NEAR}
UNION ALL SELECT 2, count(*) FROM {NEAR} x JOIN e c ON c.member = 'error' AND c.user_id = u1 AND c.entry_id > l1 AND c.entry_id - l1 <= 400""")
def seek_funnel(spark, sf):
    j = S.journal(spark, sf)
    three = view_buy(400).then_seek("[_:User].error($u3:long, _, _)").where("u3 == u1").within(400)
    return J.funnel([match(j, "[_:User].view(_, _, $k:int) where $k > 5"), detect(view_buy(400), j), detect(three, j)])


@query("SELECT r_regionkey, r_name, md5(r_name) AS h FROM region")
def hash_rows(spark, sf):
    return S.table(spark, sf, "region").select("r_regionkey", "r_name", F.md5("r_name").alias("h"))


# Messages
LEDGER = "SELECT entry_id, user_id || ':' || k AS envelope_id, CASE member WHEN 'click' THEN 'tell' WHEN 'view' THEN 'ack' WHEN 'error' THEN 'failure' END AS what FROM e"
LEDGER_SQL = f"""l AS ({LEDGER}), t AS (SELECT envelope_id, min(entry_id) AS told_at FROM l WHERE what = 'tell' GROUP BY 1),
x AS (SELECT t.*, (SELECT min(entry_id) FROM l WHERE l.envelope_id = t.envelope_id AND what = 'ack' AND entry_id > told_at) AS acked_at, (SELECT min(entry_id) FROM l WHERE l.envelope_id = t.envelope_id AND what = 'failure' AND entry_id > told_at) AS failed_at FROM t)"""


def _ledger(spark, sf):
    rows = S.entries(spark, sf).select("entry_id", F.concat_ws(":", "user_id", "k").alias("envelope_id"), "member")
    return J.ledger(rows.where("member = 'click'"), rows.where("member = 'view'"), rows.where("member = 'error'"))


@query(f"{WITH}, {LEDGER_SQL} SELECT envelope_id, told_at, acked_at, failed_at, CASE WHEN acked_at IS NOT NULL THEN 'acked' WHEN failed_at IS NOT NULL THEN 'failed' ELSE 'pending' END AS state FROM x")
def tell_pending(spark, sf):
    return _ledger(spark, sf)


@query(f"{WITH}, {LEDGER_SQL} SELECT entry_id FROM e WHERE entry_id NOT IN (SELECT told_at FROM x WHERE acked_at IS NOT NULL UNION SELECT acked_at FROM x WHERE acked_at IS NOT NULL)")
def tell_pair_elision(spark, sf):
    acked = _ledger(spark, sf).where("state = 'acked'")
    return J.scan(S.entries(spark, sf), 0, acked.select(F.explode(F.array("told_at", "acked_at")).alias("entry_id"))).select("entry_id")


@query(f"""{WITH}, v AS (SELECT user_id, entry_id, CASE member WHEN 'signup' THEN 'start' WHEN 'error' THEN 'compensate' WHEN 'purchase' THEN 'close' ELSE 'step' END AS verb FROM e),
s AS (SELECT user_id, min(entry_id) AS s FROM v WHERE verb = 'start' GROUP BY 1), c AS (SELECT v.user_id, min(entry_id) AS c FROM v JOIN s USING (user_id) WHERE verb = 'close' AND entry_id > s GROUP BY 1)
SELECT entry_id, CASE WHEN s IS NULL OR entry_id <= s THEN 'none' WHEN c IS NULL OR entry_id <= c THEN 'open' ELSE 'closed' END AS state,
coalesce(CASE WHEN verb = 'start' THEN entry_id = s ELSE entry_id > s AND (c IS NULL OR entry_id <= c) END, false) AS legal FROM v LEFT JOIN s USING (user_id) LEFT JOIN c USING (user_id)""")
def saga_valid(spark, sf):
    verb = F.when(F.col("member") == "signup", "start").when(F.col("member") == "error", "compensate").when(F.col("member") == "purchase", "close").otherwise("step")
    rows = S.entries(spark, sf).select(F.col("user_id").alias("actor"), "entry_id", verb.alias("verb"))
    return J.saga_check(rows).select("entry_id", "state", "legal")


@query(f"""WITH RECURSIVE e AS ({E}), m AS (SELECT entry_id, occurred_at, user_id || member AS id, row_number() OVER (PARTITION BY user_id, member ORDER BY entry_id) AS r FROM e),
f(id, r, entry_id, last, accepted) AS (SELECT id, r, entry_id, occurred_at, true FROM m WHERE r = 1 UNION ALL
SELECT m.id, m.r, m.entry_id, CASE WHEN m.occurred_at - f.last >= INTERVAL 2 DAY THEN m.occurred_at ELSE f.last END, m.occurred_at - f.last >= INTERVAL 2 DAY FROM f JOIN m ON m.id = f.id AND m.r = f.r + 1)
SELECT entry_id, accepted FROM f""")
def dispatch_dedup(spark, sf):
    rows = S.entries(spark, sf).select("entry_id", "occurred_at", F.concat("user_id", "member").alias("message_id"))
    return J.dedup_window(rows, timedelta(days=2)).select("entry_id", "accepted")


@query(f"{WITH} SELECT entry_id FROM e WHERE member = 'click' AND k < 2")
def playbill_orphans(spark, sf):
    e = S.entries(spark, sf)
    return J.orphans(e.where("member = 'click'"), e.where("k >= 2")).select("entry_id")


@query(f"{WITH} SELECT f AS follower_id, entry_id FROM e JOIN (VALUES (1, 9000), (2, 9500)) x(f, c) ON entry_id > c")
def follower_resume(spark, sf):
    followers = spark.createDataFrame([(1, 9000), (2, 9500)], "destination int, last_confirmed long")
    return J.unread(S.entries(spark, sf).select("entry_id"), followers).select(F.col("destination").alias("follower_id"), "entry_id")


@query(f"{WITH} SELECT user_id::VARCHAR AS actor, max(occurred_at) AS last_at, count(*) AS n FROM e GROUP BY user_id HAVING max(occurred_at) < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY")
def ensemble_idle(spark, sf):
    return J.idle(S.user_entries(spark, sf), F.lit("2024-01-31").cast("timestamp_ntz"), timedelta(days=2))


@query(f"""{WITH}, a AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM e WHERE NOT (member = 'view' AND k = 1) GROUP BY 1)
SELECT *, 'lost' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def elision_impact(spark, sf):
    e = S.entries(spark, sf)
    observe = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"))
    return J.impact(observe(e), observe(J.scan(e, 0, e.where("member = 'view' AND k = 1"))))


# Sets, windows, top-k
@query("""SELECT 'union' AS op, n_regionkey AS x FROM (SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region) UNION ALL
SELECT 'except', s FROM (SELECT DISTINCT s_nationkey AS s FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 10) UNION ALL
SELECT 'intersect', s FROM (SELECT s_nationkey AS s FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_nationkey < 10) UNION ALL
SELECT 'product', r_regionkey * 100 + n_nationkey FROM region, nation""")
def set_ops(spark, sf):
    n, r, s, c = (S.table(spark, sf, t) for t in ("nation", "region", "supplier", "customer"))
    some = c.where("c_nationkey < 10").select(F.col("c_nationkey").alias("x"))
    parts = {
        "union": n.select(F.col("n_regionkey").alias("x")).union(r.select("r_regionkey")).distinct(),
        "except": s.select(F.col("s_nationkey").alias("x")).subtract(some), "intersect": s.select(F.col("s_nationkey").alias("x")).intersect(some),
        "product": r.crossJoin(n).select((F.col("r_regionkey") * 100 + F.col("n_nationkey")).alias("x")),
    }
    out = None
    for op, d in parts.items():
        out = d.select(F.lit(op).alias("op"), "x") if out is None else out.unionByName(d.select(F.lit(op).alias("op"), "x"))
    return out


@query("SELECT destination, entry_id, v FROM (SELECT c_custkey AS entry_id, c_mktsegment AS destination, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 32")
def last_n_ring(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_mktsegment").alias("destination"), F.col("c_acctbal").alias("v"))
    ring = F.row_number().over(Window.partitionBy("destination").orderBy(F.col("v").desc(), "entry_id"))
    return c.withColumn("r", ring).where("r <= 32").drop("r")


@query("""SELECT destination, max(x) AS entry_id FROM (SELECT c_mktsegment AS destination, c_custkey AS x FROM customer UNION ALL SELECT c_mktsegment, c_custkey + 1 FROM customer WHERE c_acctbal < 0) GROUP BY destination""")
def keyed_merge(spark, sf):
    c = S.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("destination")).agg(F.max("c_custkey").alias("entry_id"))
    new = S.table(spark, sf, "customer").where("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("destination")).agg((F.max("c_custkey") + 1).alias("entry_id"))
    return c.unionByName(new).groupBy("destination").agg(F.max("entry_id").alias("entry_id"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def tpch_like_rollup(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"{WITH} SELECT entry_id, max(k) OVER (PARTITION BY user_id ORDER BY entry_id ROWS UNBOUNDED PRECEDING) AS high, CAST(count(*) OVER (PARTITION BY user_id ORDER BY entry_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM e")
def running_windows(spark, sf):
    e, w = S.entries(spark, sf), Window.partitionBy("user_id").orderBy("entry_id")
    return e.select("entry_id", F.max("k").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), F.count("*").over(w.rangeBetween(-100, 0)).alias("near"))



# Documents, programs and sources
@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","lines":[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']}' AS doc
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def document_json(spark, sf):
    o, li = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    item = lambda x: [("n", Typed(x["l_linenumber"], "int")), ("part", Typed(x["l_partkey"], "long"))]
    doc = to_json(("key", Typed(F.col("o_orderkey"), "long")), ("status", Typed(F.col("o_orderstatus"), "string")), ("lines", F.col("lines"), item))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select("o_orderkey", doc.alias("doc"))


@query("""SELECT n_nationkey, 'key: ' || n_nationkey || chr(10) || 'name: "' || n_name || '"' AS listed, '<root>' || chr(10) || '  <key>' || n_nationkey || '</key>' || chr(10) || '  <name>' || n_name || '</name>' || chr(10) || '</root>' || chr(10) AS xml FROM nation""")
def document_list_xml(spark, sf):
    parts = [("key", Typed(F.col("n_nationkey"), "int")), ("name", Typed(F.col("n_name"), "string"))]
    return S.table(spark, sf, "nation").select("n_nationkey", to_list(*parts).alias("listed"), to_xml(*parts).alias("xml"))


@query(f"{WITH} SELECT entry_id, CAST(k AS VARCHAR) AS found FROM e")
def json_alias(spark, sf):
    rows = S.entries(spark, sf)
    nested = F.concat(F.lit('{"outer":[{"x":1},'), F.col("expose"), F.lit("]}"))
    return rows.select("entry_id", F.array_join(find_alias(nested, "k"), ";").alias("found"))


@query(f"{WITH} SELECT entry_id, 'SCRIPT' AS kind, 'user_' || user_id || '.' || member || '(' || k || ', ''' || member || ''');' AS script, occurred_at FROM e")
def segment_round_trip(spark, sf):
    rows = S.scripts(spark, sf).select("entry_id", "occurred_at", F.lit("SCRIPT").alias("kind"), "script", F.lit(None).cast("int").alias("action_id"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("string").alias("define_text"), "expose")
    return decode_segments(encode_segments(rows, compress=True)).select("entry_id", "kind", "script", "occurred_at")


@query(f"{WITH} SELECT member, count(*) AS n, count(DISTINCT user_id) AS users, min(entry_id) AS first, max(entry_id) AS last FROM e GROUP BY member")
def show_members(spark, sf):
    return S.entries(spark, sf).groupBy("member").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("entry_id").alias("first"), F.max("entry_id").alias("last"))


@query(f"{WITH} SELECT user_id, round(100.0 * count(CASE WHEN member = 'purchase' THEN 1 END) / nullif(count(CASE WHEN member = 'view' THEN 1 END), 0), 6) AS ratio FROM e GROUP BY user_id")
def hit_ratio(spark, sf):
    is_ = lambda m: F.count(F.when(F.col("member") == m, 1))
    return S.entries(spark, sf).groupBy("user_id").agg(F.round(F.lit(100.0) * is_("purchase") / F.nullif(is_("view"), F.lit(0)), 6).alias("ratio"))


@query("SELECT c_custkey, c_nationkey, coalesce(r, -1) AS r FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey AS r FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def registry_lookup(spark, sf):
    n = S.table(spark, sf, "nation").where("n_regionkey <> 2").select("n_nationkey", F.col("n_regionkey").alias("r"))
    c = S.table(spark, sf, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_nationkey", F.coalesce("r", F.lit(-1)).alias("r"))


# Streams: each runs to the end of what is there, from an empty checkpoint
def _streamed(spark: SparkSession, sf: str, build) -> DataFrame:
    """What a streaming query over the user journal writes."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    S.user_journal(spark, sf).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    out = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(f"""{WITH} SELECT a.user_id::VARCHAR AS actor, a.entry_id || ',' || b.entry_id AS levels, b.entry_id AS trigger_entry_id FROM u a JOIN u b ON a.user_id = b.user_id AND a.member = 'view' AND b.member = 'purchase'
AND b.entry_id > a.entry_id AND b.entry_id <= a.entry_id + 3 AND b.k > a.k""")
def stream_chain(spark, sf):
    r = reaction("stream").seek("[User].view(_, _, $k1:int)").then_final_seek("[User].purchase(_, _, $k2:int)").where("k2 > k1").within(3)
    return _streamed(spark, sf, lambda s: detect_stream(r, s)).select("actor", "levels", "trigger_entry_id")


@query(f"{WITH} SELECT user_id::VARCHAR AS actor, min(entry_id) AS entry_id FROM u WHERE member = 'click' GROUP BY user_id")
def stream_first(spark, sf):
    r = reaction("first").seek("[User].click(_, _, _)").many()
    return _streamed(spark, sf, lambda s: detect_stream(replace(r, stale_after=None), s)).select("actor", F.col("trigger_entry_id").alias("entry_id"))


# Registry, order, sagas and event-time windows
@query("SELECT o_orderkey AS reaction_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def active_reactions(spark, sf):
    o = S.table(spark, sf, "orders")
    activation = F.when(F.col("o_orderpriority") == "1-URGENT", "company").when(F.col("o_orderpriority") == "2-HIGH", "director").otherwise("cast")
    rows = o.select(F.col("o_orderkey").alias("reaction_id"), (F.col("o_orderstatus") != "F").alias("active"), F.col("o_orderdate").alias("expires_at"), activation.alias("activation"))
    return J.active(rows, F.lit("1997-01-01").cast("timestamp_ntz"), "director").select("reaction_id")


@query("SELECT l_orderkey AS reaction_id, l_linenumber AS seek_level, l_partkey - l_suppkey AS gap FROM lineitem WHERE l_partkey > l_suppkey")
def checkpoint_gap(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("reaction_id"), F.col("l_linenumber").alias("seek_level"), F.col("l_partkey").alias("detected"), F.col("l_suppkey").alias("confirmed"))
    return J.unconfirmed(rows).select("reaction_id", "seek_level", "gap")


@query(f"{WITH}, x AS (SELECT user_id, entry_id, entry_id - lag(entry_id) OVER (PARTITION BY user_id ORDER BY entry_id) - 1 AS missing FROM u WHERE member <> 'error') SELECT user_id::VARCHAR AS actor, entry_id, missing FROM x WHERE missing > 0")
def order_gaps(spark, sf):
    return J.gaps(S.user_entries(spark, sf).where("member <> 'error'")).select("actor", "entry_id", "missing")


@query(f"{WITH} SELECT user_id, member, k, min(entry_id) AS entry_id FROM e GROUP BY ALL")
def saga_steps_once(spark, sf):
    return J.steps_once(S.entries(spark, sf), ["user_id", "member", "k"])


@query(f"""{WITH}, s AS (SELECT user_id, min(entry_id) AS s FROM e WHERE member = 'signup' GROUP BY 1), c AS (SELECT e.user_id, any_value(s) AS s, min(entry_id) AS c FROM e JOIN s USING (user_id) WHERE member = 'purchase' AND entry_id > s GROUP BY 1)
SELECT e.user_id::VARCHAR AS actor, entry_id FROM e JOIN c USING (user_id) WHERE entry_id BETWEEN s AND c AND (member <> 'signup' OR entry_id = s)""")
def saga_elision(spark, sf):
    verb = F.when(F.col("member") == "signup", "start").when(F.col("member") == "error", "compensate").when(F.col("member") == "purchase", "close").otherwise("step")
    rows = S.entries(spark, sf).select(F.col("user_id").cast("string").alias("actor"), "entry_id", verb.alias("verb"))
    return J.closed_trajectories(rows)


@query(f"{WITH} SELECT time_bucket(INTERVAL 6 HOUR, occurred_at) AS start, member, count(*) AS n FROM e GROUP BY ALL")
def tumbling_counts(spark, sf):
    return counts(S.entries(spark, sf), "6 hours").select(F.col("window.start").alias("start"), "member", "n")


@query(f"""{WITH}, g AS (SELECT user_id, occurred_at, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY user_id ORDER BY entry_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS cut FROM e),
s AS (SELECT user_id, occurred_at, sum(cut) OVER (PARTITION BY user_id ORDER BY occurred_at) AS lap FROM g) SELECT user_id::VARCHAR AS actor, min(occurred_at) AS start, count(*) AS n FROM s GROUP BY user_id, lap""")
def session_counts(spark, sf):
    return sessions(S.user_entries(spark, sf), "4 hours").select("actor", F.col("session_window.start").alias("start"), "n")


@query()
def tell_hash(spark, sf):
    """FNV-1a of each tell; no SQL, as DuckDB has no such hash: tests hold it against plain Python."""
    return S.entries(spark, sf).select("entry_id", J.fnv1a64(F.concat_ws("|", "user_id", "member", "k")).alias("hash"))
