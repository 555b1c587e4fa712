"""The script and pattern languages, expressions against plain evaluation, facts and the file store."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logloom.functions.expr import TypeFault, Typed, over, text
from logloom.functions.match import match, prefilter
from logloom.lang import facts as L
from logloom.lang import patterns as P
from logloom.lang import syntax as S
from logloom.operators import journal as J
from logloom.sources.journals import JOURNAL, parse_scripts
from logloom.sources.store import Conflict, JournalStore
from logloom.streaming.engine import evaluate

ROW = {"i": 7, "j": -2, "d": 2.5, "s": "it", "b": True, "t": datetime(2024, 3, 1, 12, 0, 5), "n": None, "xs": [3, 4, 5]}
SCHEMA = "i int, j int, d double, s string, b boolean, t timestamp_ntz, n int, xs array<int>"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([tuple(ROW.values())], SCHEMA)


@pytest.mark.parametrize("source", [
    "i + j * 2", "i / j", "j / 2", "-i / 2", "d * 2 - i", "i > 3 && d < 3.0", "!b || i == 7", "b ? i : j", "s + i", "s == 'it'", "n == null", "n != null", "i == 7.0",
    "xs[1] + xs.Count", "{1, 2, i}", "(i + j) * 3", "'a\\'b' + s", "t > 01/01/2024", "i >= 7 ? 'x' : 'y'", "!i == 7", "(int) d + i", "xs == {3, 4, 5}", "i != 8 && (j < 0 || b)",
])
def test_columns_agree_with_evaluation(row, source):
    tree = S.parse_expression(source)
    got = row.select(over(row).typed(tree).col.alias("x")).first().x
    want = evaluate(tree, ROW)
    assert got == want, (got, want)


def test_decimals_keep_ten_digits(row):
    c = over(row)
    got = row.select(c.column("1.5m * 2.25m").alias("p"), c.column("10m / 4").alias("q"), c.column("d + 0.1m").alias("s")).first()
    assert (got.p, got.q, got.s) == (Decimal("3.375"), Decimal("2.5"), Decimal("2.6"))
    assert c.typed(S.parse_expression("d + 1m")).type == "decimal" and c.typed(S.parse_expression("i + d")).type == "double"


@pytest.mark.parametrize("source", ["s < 'x'", "i && b", "b + 1", "(int) s", "unknown + 1", "s.Nothing()", "-s"])
def test_types_are_checked(row, source):
    with pytest.raises(TypeFault):
        over(row).column(source)


@pytest.mark.parametrize("source", ["1 +", "a b", "3000000000", "(1", "'open", "{1, 2"])
def test_faults(source):
    with pytest.raises(S.SyntaxFault):
        S.parse_expression(source)


def test_dates_as_text(spark):
    df = spark.sql("select timestamp_ntz'2024-03-01 00:00:00' a, timestamp_ntz'2024-03-01 12:00:05' b")
    assert df.select(text(Typed(F.col("a"), "datetime")), text(Typed(F.col("b"), "datetime"))).first() == ("03/01/2024", "03/01/2024 12:00:05")


def test_statements():
    kinds = [s.kind for s in S.parse_program("x = Order(1, 'a'); if (x.Total > 3) { x.Close(); } else x.Open(); for (i, y in x.Lines) { print y.Id id; } check(x.Ok) error 'bad'; notify warning 'w'; expose x.Id as key; tell Bank(7) start Pay(3) id 'k'; tell ack 'k' from Bank(7); upgrade('v2') { x = null; } define action 7 (p:int) as x.Add(p); end; eval('y = 1;');")]
    assert kinds == ["assign", "if", "for", "check", "notify", "expose", "tell", "ack", "upgrade", "define", "eval"]
    for bad in ("print 1;", "check(1) fatal 'x';", "x = ;", "if (a) { b();"):
        with pytest.raises(S.SyntaxFault):
            S.parse_program(bad)


def test_skeletons_give_the_facts_of_each_text(spark):
    texts = [
        "o.Add(3, 'a b', -5, 2.5, 007, 4m);", "o.Add(4, 'it\\'s', -6, 2.5, 007, 4m);", "x = 1 / 2; y = a[3].b(4);", "o.At(01/02/2024 10:20:30, 5);", "o.At(1/2/2024, 'x');",
        "// note 5\no.Add(1);", "eval('o.Add(1);');", "o1.Add(2147483647);", "z = c ? 1 : 2; o.Add('\x01');", "o.Add('',0);", "tell Bank(7) Pay(1) id 'k';", "o.Add(1", "x = 'a' + 5 + b5;", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id int, script string")
    got = {r.entry_id: r.calls for r in parse_scripts(df, types={"Order": ["Order"]}, variables={"o": "Order"}).collect()}
    for i, t in enumerate(texts):
        try:
            want = t and L.facts(t, types={"Order": ["Order"]}, variables={"o": "Order"})
        except S.SyntaxFault:
            want = None
        have = got[i] and [{**r.asDict(), "args": [a.asDict() for a in r.args]} for r in got[i]]
        assert have == want, t


def scripts(spark, *texts):
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "entry_id long, script string")
    df = df.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("actor", F.lit("")).withColumn("expose", F.lit(None).cast("string"))
    return parse_scripts(df, types={"Order": ["Order", "Document"], "Item": ["Item"]}, variables={"o": "Order"})


@pytest.mark.parametrize("pattern, want", [
    ("[Order].Add($n:int)", [(1, 3), (3, 9)]), ("[Document].Add($n:int)", [(1, 3), (3, 9)]), ("[o:Order].Add($n:int)", [(1, 3), (3, 9)]),
    ("[Order].Add($n:int) [Order].Ship()", [(1, 3)]), ("[Order].Ship() ... [Order].Add($n:int)", [(3, 9)]), ("[Order].Add(3)", [(1, None)]),
    ("[Order].Add($n:string)", []), ("Item($x)", [(2, None)]), ("[Item]('a':string)", [(2, None)]), ("$v = Item('a');", [(2, None)]), ("w = _;", [(2, None), (4, None)]),
    ("[Order].Total", [(4, None)]), ("[Order].Add($n:int) || [Order].Total", [(1, 3), (3, 9), (4, None)]), ("[Order].Add($n:int) where $n > 5", [(3, 9)]),
    ("[Order].Add(_) where contains 'Ship'", [(1, None), (3, None)]), ("[Order].Add(_) where not contains 'Ship'", []), ("tell Bank($n) Pay(_)", [(5, 7)]), ("tell ack $n", [(6, 7)]),
    ("[Order].Put([Order].Inner($n:int))", [(8, 4)]),
])
def test_patterns(spark, pattern, want):
    df = scripts(spark, "o.Add(3); o.Ship();", "w = Item('a');", "o.Ship(); o.Add(9);", "x = o.Total;", "tell Bank(7) Pay(1) id 'k';", "tell ack 7;", "this is no script", "o.Put(o.Inner(4)); o.Inner(4);")
    found = match(df, pattern)
    name = next((n for n in ("n",) if n in found.columns), None)
    assert sorted((r.entry_id, int(r[name]) if name and r[name] is not None else None) for r in found.collect()) == sorted(want, key=lambda x: (x[0], x[1] or 0))


def test_pattern_faults():
    for bad in ("", "[Order", "[A].b(", "x = [A].b();", "[A].b() where x > 1", "[A].b($v) where $v ~ 1"):
        with pytest.raises(S.SyntaxFault):
            P.parse_pattern(bad)


def test_expose_and_prefilter(spark):
    df = scripts(spark, "o.Add(3);").withColumn("expose", F.lit('{"key": 5, "name": "n"}'))
    assert match(df, "[Order].Add(_) expose $q:int key;").first().q == 5
    assert match(df, "expose 'm' name;").count() == 0
    assert [r[0] for r in df.select(prefilter(F.col("script"), ["o.", "ADD"])).collect()] == [True]
    assert L.facts("o.Add(1 + 2);", variables={"o": "Order"})[-1]["args"][0]["value"] is None


def test_shapes_and_hashes(spark):
    df = spark.createDataFrame([("a.B(1, 'x\\'y', 2.5m); // c",), ("a.B(22,  '', 3); ",)], "s string")
    assert {r[0] for r in df.select(J.shape(F.col("s"))).collect()} == {"a.B(?, ?, ?);"}
    assert df.select(J.literals(F.col("s"))).first()[0] == ["1", "'x\\'y'", "2.5m"]

    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    words = ["", "a", "foobar", "é漢", "x" * 50]
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", J.fnv1a64(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in out} == {w: fnv(w.encode()) for w in words}


def entries(spark, ids, **extra):
    rows = [(i, datetime(2024, 1, 1 + i % 20), "SCRIPT", f"o.Add({i});", None, None, None, None, "u") for i in ids]
    return spark.createDataFrame(rows, JOURNAL)


def test_store(spark, tmp_path):
    store = JournalStore(spark, str(tmp_path / "store"))
    assert store.last_id() == 0 and store.scan().count() == 0
    store.append(entries(spark, range(1, 11)))
    with pytest.raises(ValueError):
        store.append(entries(spark, [10]))
    marks = spark.createDataFrame([(3, "r"), (10, "r"), (3, "r")], "entry_id long, reaction_id string")
    point = spark.createDataFrame([("r", 0, 3, 3)], store.schema("checkpoint"))
    store.elide(marks, point, expected=point.limit(0))
    with pytest.raises(Conflict):
        store.elide(marks, point, expected=spark.createDataFrame([("r", 0, 9, 9)], store.schema("checkpoint")))
    assert store.scan().count() == 8 and store.scan(raw=True).count() == 10 and store.read("elision").count() == 2
    assert store.register("lake") and not store.register("lake")
    store.append(entries(spark, [11, 12]))
    with pytest.raises(PermissionError):
        store.distill()
    seen = []
    assert store.sync("lake", lambda df: seen.append(df.count())) == 12 and seen == [2]
    store.distill()
    assert {r.entry_id for r in store.read("journal").collect()} == set(range(1, 13)) - {3, 10} and store.read("elision").count() == 0
    old = store.manifest(1)
    assert store.read("journal", 1).count() == 10 and old
    with pytest.raises(Conflict):
        store._publish(1, {})
    box = spark.createDataFrame([(1, "m", "p", "r:1:1", 5), (2, "m", "q", "r:2:1", 4)], store.schema("outbox"))
    store.record_outbox(box)
    store.record_outbox(box)
    sent = []
    store.dispatch(lambda df: sent.extend(r.payload for r in df.collect()))
    store.dispatch(lambda df: sent.extend(r.payload for r in df.collect()))
    assert sent == ["q", "p"]
    store.record_playbill("s", "a:int", spark.createDataFrame([(1, "x"), (1, "y")], "entry_id long, params string"))
    with pytest.raises(ValueError):
        store.record_playbill("s", "a:long", spark.createDataFrame([(2, "x")], "entry_id long, params string"))
    assert store.shadow(str(tmp_path / "shadow"), 5).scan().count() == 4
    store.append_define_and_call(entries(spark, [13]), entries(spark, [14]))
    assert store.last_id() == 14


def test_segments(spark, tmp_path):
    from logloom.sources import segments as G

    rows = entries(spark, range(1, 200)).withColumn("expose", F.when(F.col("entry_id") % 3 == 0, '{"k": 1}'))
    define = spark.createDataFrame([(200, datetime(2024, 2, 1, 1, 2, 3, 456), "DEFINE", None, 7, None, "define action 7 () as end;", None, "u"), (201, datetime(2024, 2, 1), "INVOCATION", None, 7, "1,2", None, None, "u")], JOURNAL)
    both = rows.unionByName(define)
    for compress in (False, True):
        at = str(tmp_path / f"seg{compress}")
        assert G.write_segments(both, at, segment_bytes=2000, compress=compress) > 3
        back = G.read_segments(spark, at)
        assert sorted(back.collect()) == sorted(both.select(*back.columns).collect())
    record = G.encode({"kind": "SCRIPT", "entry_id": 1, "occurred_at": datetime(2024, 1, 1), "script": "a.b();"})
    assert len(list(G.decode(record + record[:-3]))) == 1 and list(G.decode(b"")) == []
    with pytest.raises(G.Damaged):
        list(G.decode(record[:-1] + b"x"))


def test_documents(spark):
    from logloom.functions.render import find_alias, to_json, to_list, to_xml

    df = spark.createDataFrame([(1, 'a"<b', 2.0, None, [1, 2], datetime(2024, 1, 2))], "i int, s string, d double, n int, xs array<int>, t timestamp_ntz")
    parts = [("i", Typed(F.col("i"), "int")), ("s", Typed(F.col("s"), "string")), ("d", Typed(F.col("d"), "double")), ("n", Typed(F.col("n"), "int")), ("xs", F.col("xs"), lambda x: [("x", Typed(x, "int"))]), ("t", Typed(F.col("t"), "datetime"))]
    j, listed, x = df.select(to_json(*parts), to_list(*parts), to_xml(*parts)).first()
    assert j == '{"i":1,"s":"a\\"<b","d":2.0,"n":null,"xs":[{"x":1},{"x":2}],"t":"01/02/2024"}'
    assert listed == 'i: 1\ns: "a\\"<b"\nd: 2\nn: null\nxs:\n  - x: 1\n  - x: 2\nt: 01/02/2024'
    assert "<s>a\"&lt;b</s>" in x and "<n/>" in x and "<item>" in x and x.startswith("<root>\n")
    assert df.select(find_alias(F.lit('{"a":1,"b":{"a":"x","c":[{"a":null}]}}'), "a")).first()[0] == ["1", '"x"', "null"]


def test_pattern_on_scripts_of_any_user_id(spark, tmp_path):
    from logloom import queries

    rows = [(i, u, "click") for i, u in enumerate([0, 4999, 5000, 14999, 10**12])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    events = events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("value", F.lit(1.0)).withColumn("props", F.lit('{"k": 1}'))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.user_id for r in queries.pattern_on_scripts(spark, str(tmp_path)).collect()) == [0, 4999, 5000, 14999, 10**12]


def test_canonical_texts():
    one = "if (a.b(1, 'x  y') > -2) { c = {1, 2}; } // end"
    two = "if(a . b( 1,'x  y' )> -2)\n{c={1,2};}/* z */"
    assert S.canonical(one) == S.canonical(two) == "if (a.b(1, 'x  y') > - 2) { c = { 1, 2 }; }"
    assert S.parse_program(S.canonical(one)) == S.parse_program(one) and S.canonical(S.canonical(one)) == S.canonical(one)
