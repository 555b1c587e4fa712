"""Programs run: the interpreter, programs compiled to columns against it, replay of journals, parsing of plain cases."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logloom.functions.expr import TypeFault, over
from logloom.lang import syntax as S
from logloom.lang.interpret import Machine, document_json
from logloom.operators import programs as R
from logloom.plans import program as P


class Account:
    def __init__(self, owner: str, balance: int):
        self.Owner, self.Balance = owner, balance

    def Deposit(self, n: int) -> int:
        if n < 0:
            raise ValueError("negative")
        self.Balance += n
        return self.Balance


def run(machine, script, **options):
    return machine.run(S.parse_program(script), **options)


def test_state_lives_from_entry_to_entry():
    m = Machine({"Account": Account})
    assert run(m, "a = Account('ann', 5); n = 1; { inner = 2; n = n + inner; }").error is None
    out = run(m, "a.deposit(7); print a.balance b, n n, a.OWNER + ' has ' + a.Balance text; expose n as n;", now=datetime(2024, 1, 1))
    assert out.document == {"b": 12, "n": 3, "text": "ann has 12"} and out.exposed == {"n": 3} and "inner" not in m.symbols
    failed = run(m, "n = 10; a.Deposit(-1); n = 11;")
    assert "negative" in failed.error and m.symbols["n"] == 10  # what was done before a fault stays
    assert "unknown name" in run(m, "print nothing x;").error and "no member" in run(m, "a._x = 1;").error
    assert run(m, "a.Balance = 1; print a.Balance b;").document == {"b": 1}
    assert m.types == {"a": "Account", "n": "int"}


def test_queries_change_nothing():
    m = Machine()
    run(m, "n = 1;")
    for bad in ("n = 2;", "k = 2;", "expose n as n;"):
        assert run(m, bad, query=True).error
    assert run(m, "{ k = 2; print n + k x; }", query=True).document == {"x": 3} and m.symbols == {"n": 1}


def test_actions_upgrades_checks_and_messages():
    m = Machine()
    run(m, "total = 0; define action 3 (p:int, s:string) as total = total + p; print s s; end;")
    assert m.invoke(3, [4, "x"]).document == {"s": "x"} and m.symbols["total"] == 4
    assert "no action" in m.invoke(9, []).error and "takes 2" in m.invoke(3, [1]).error
    for _ in range(2):
        run(m, "upgrade('v2') { total = total + 100; }")
    assert m.symbols["total"] == 104
    parse = S.parse_program
    assert m.check_then(parse("check(total > 200) error 'low';"), parse("total = 0;")).diagnostics == [("error", "low")] and m.symbols["total"] == 104
    assert m.check_then(parse("check(total > 200) warning 'low';"), parse("total = 0;")).diagnostics == [("warning", "low")] and m.symbols["total"] == 0
    out = run(m, "tell Bank(1) start Pay(2) id 'k'; tell ack 5 from Bank(1); notify information 1 + 2; eval('total = 7;');")
    assert out.messages == [{"to": ["Bank", 1], "verb": "start", "command": ["Pay", 2], "id": "k"}, {"ack": "5"}] and out.diagnostics == [("information", "3")] and m.symbols["total"] == 7


def test_documents_of_loops():
    m = Machine()
    out = run(m, "xs = {1, 2, 3}; for (i, x in xs) { if (x > 1) print i at, x * 1.0 v; } for (y : {5}) { for (z : {'a'}) print z + y t; } for (w : {1}) { q = w; } print xs xs, null none, true yes, 1.50m d;")
    assert document_json(out.document) == '{"x":[{"at":1,"v":2.0},{"at":2,"v":3.0}],"y":[{"z":[{"t":"a5"}]}],"xs":[1,2,3],"none":null,"yes":true,"d":1.5}'
    assert out.document["d"] == Decimal("1.50")


PROGRAMS = [
    "t = a + 1; if (t > 10) { t = t * 2; print 'big' size; } else print 'small' size; print t total, b real;",
    "for (i, x in ys) { print i at, x n; if (x > 1) print x * a p; }",
    "u = 0; for (y : ys) { if (y > 1) { u = u + y; } } n = 0; for (_, y in ys) n = n + 1; print u u, n n;",
    "if (a > 10) { if (b > 1.0) print 1 x; else print 2 x; } print (a > 3 && b < 3.0) both, -a m, a / 2 h;",
    "eval('q = a * 2;'); { q = q + 1; r = 5; } print q q; if (a > 10) { q = 0; } print q q;",
    "print s + ' ' + a + ' ' + b + ' ' + (a > 3) + ' ' + 1.50m text, ys.Count c;",
    "for (y : ys) { z = y + 1; print z z; { print z + 1 w; } }",
]


@pytest.mark.parametrize("script", PROGRAMS)
def test_columns_say_what_the_interpreter_says(spark, script):
    rows = [(1, 5, 2.5, "x", [1, 2, 3]), (2, 50, 0.0, "y", []), (3, 11, 1.25, "", [7])]
    df = spark.createDataFrame(rows, "k int, a int, b double, s string, ys array<int>")
    got = {r.k: r.document for r in P.run_documents(df, script, ["k"]).collect()}
    for k, a, b, s, ys in rows:
        m = Machine()
        m.symbols.update({"a": a, "b": b, "s": s, "ys": ys})
        out = m.run(S.parse_program(script))
        assert out.error is None and got[k] == document_json(out.document)


def test_programs_are_checked(spark):
    df = spark.createDataFrame([(1, [1])], "k int, ys array<int>")
    for bad in ("x.y();", "if (k) print 1 a;", "for (x : k) print x x;", "n = 0; for (x : ys) { n = n + 1; print n n; }", "print other a;", "k = 'text';"):
        with pytest.raises((TypeFault, TypeError)):
            P.run_documents(df, bad, ["k"])


def test_structs_lists_and_further_members(spark):
    df = spark.sql("select named_struct('Id', 7, 'in', named_struct('x', 2.5d)) o, array(3, 1, 2) ys, 'a.b.c' s, timestamp_ntz'2024-03-31 10:00:00' t")
    c = over(df)
    got = df.select(
        c.column("o.id + 1").alias("a"), c.column("o.In.X").alias("b"), c.column("ys.Reverse()[0]").alias("c"), c.column("ys.Max() - ys.Min()").alias("d"), c.column("ys.IndexOf(2)").alias("e"),
        c.column("s.Split('.').Count").alias("f"), c.column("s.LastIndexOf('.')").alias("g"), c.column("s.Remove(2)").alias("h"), c.column("t.AddMonths(1)").alias("i"), c.column("Math.Sign(0 - 5)").alias("j"),
        c.column("ys.Take(2).Sum()").alias("k"), c.column("ys.Distinct().Contains(9)").alias("l"), c.column("s.PadRight(7)").alias("m"),
    ).first()
    assert tuple(got) == (8, 2.5, 2, 2, 2, 3, 3, "a.", datetime(2024, 4, 30, 10), -1, 4, False, "a.b.c  ")


def test_replay_of_odd_journals(spark):
    rows = [("a", 1, "n = 1;"), ("a", 2, "this is no script"), ("a", 3, None), ("b", 1, "n = 'text'; m = {1, 2};"), ("a", 4, "print n n;"), (None, 1, "n = 5;"), ("b", 2, "n = null;")]
    df = spark.createDataFrame(rows, "actor string, entry_id long, script string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    entries = {(r.actor, r.entry_id): r for r in R.run_entries(df).collect()}
    assert entries["a", 2].error.startswith("SyntaxFault") and "no action" in entries["a", 3].error and entries["a", 4].document == '{"n":1}'
    symbols = {(r.actor, r.symbol): (r.static_type, r.runtime_type, r.value) for r in R.show_symbols(df).collect()}
    assert symbols == {("a", "n"): ("int", "int", "1"), ("b", "n"): ("string", "null", ""), ("b", "m"): ("list<int>", "list<int>", "[1,2]"), (None, "n"): ("int", "int", "5")}
    assert R.run_entries(df.limit(0)).count() == 0 and R.show_symbols(df.limit(0)).count() == 0


def test_replay_with_domain_classes(spark):
    df = spark.createDataFrame([("a", 1, "x = Twice(4);"), ("a", 2, "print x y;")], "actor string, entry_id long, script string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = R.run_entries(df, functions={"Twice": lambda n: 2 * n}).orderBy("entry_id").collect()
    assert out[1].document == '{"y":8}'
