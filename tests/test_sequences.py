"""Batch plans against the entry-by-entry matcher on random journals, and the streaming operator against both."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.plans.batch import accept_increasing, detect
from logloom.plans.reaction import parse_for_each, reaction
from logloom.sources.journals import argument, fact
from logloom.streaming.engine import Matcher
from logloom.streaming.operators import detect_stream

T0 = datetime(2024, 1, 1)


def random_rows(seed, n=60, actors=3):
    r = random.Random(seed)
    rows, at = [], {a: T0 for a in range(actors)}
    ids = {a: 0 for a in range(actors)}
    for _ in range(n):
        a = r.randrange(actors)
        ids[a] += r.choice([1, 1, 1, 2, 5])
        at[a] += timedelta(minutes=r.choice([0, 1, 5, 30]))
        rows.append((f"u{a}", ids[a], at[a], r.choice("abc"), r.randrange(4), f"recv{r.randrange(2)}"))
    return rows


def journal(spark, rows):
    df = spark.createDataFrame(rows, "actor string, entry_id long, occurred_at timestamp_ntz, member string, k int, receiver string")
    return df.withColumn("calls", F.array(fact(F.lit(0), "call", F.col("receiver"), "User", F.col("member"), argument("int", F.col("k")))))


def entry(r):
    call = {"pos": 0, "node": "call", "receiver": r[5], "receiver_type": "User", "supertypes": ["user"], "member": r[3], "args": [{"type": "int", "value": str(r[4]), "var_name": None, "is_out": False}]}
    return {"entry_id": r[1], "occurred_at": r[2], "calls": [call]}


def a(pattern="[_:User].a($x:int)"):
    return reaction("r").seek(pattern)


MINUTES = timedelta(minutes=20)
SPECS = {
    "pair": a().then_seek("[_:User].b($y:int)").where("x == y"),
    "pair_entries": a().then_seek("[_:User].b($y:int)").within(4),
    "pair_time": a().then_seek("[_:User].b($y:int)").where("y >= x && @EntryId != 7").within(MINUTES),
    "seek_names": a().then_seek("[User].b(_)").where("@EntryId - Seek.@EntryId == 3 || @Now - Seek.@Now > time.Minutes(40)"),
    "unify": reaction("r").seek("[who:User].a(_)").then_seek("[who:User].b(_)"),
    "triple": a().then_seek("[_:User].b($y:int)").within(6).then_final_seek("[_:User].c($z:int)").where("z != x").within(6),
    "or_guard": reaction("r").seek("[User].a($x:int) as 'l' || [User].b($x:int) as 'm' where $x > 1").then_seek("[User].c(2)"),
    "many_leaf": a().then_final_seek("[_:User].b($y:int)").many().within(8),
    "many_leaf3": replace(a().then_final_seek("[_:User].b($y:int)").many(3), stale_after=None),
    "many_leaf_stale": replace(a().then_final_seek("[_:User].b($y:int)").many(), stale_after=6),
    "many_root": replace(a().many(2), stale_after=None),
    "many_middle": a().many(2).then_seek("[_:User].b($y:int)").within(4),
    "many_middle2": a("[User].c($x:int)").then_seek("[_:User].a(_)").many(2).then_final_seek("[_:User].b($y:int)").within(5),
    "none": a().then_final_seek("[User].b(_)").none().within(4),
    "one_time": a().then_final_seek("[User].b(_)").one().within(MINUTES),
    "two": a().then_final_seek("[User].b($y:int)").where("y > 0").exactly(2).within(9),
    "none_not_final": a().then_seek("[User].b(_)").none().within(4),
    "exact_middle": a().then_seek("[User].b(_)").none().within(3).then_final_seek("[User].c($z:int)").within(9),
    "one_middle": a().then_seek("[User].b(_)").one().within(5).then_final_seek("[User].c($z:int)").within(12),
}


def key(m, names):
    return (tuple(m["levels"]), tuple(m["chain"]), m["trigger_entry_id"], m["trigger_at"], tuple(m[n] for n in names))


def expected(spec, rows, finders=None):
    out = []
    for actor in sorted({r[0] for r in rows}):
        m = Matcher(spec, finders)
        for r in sorted((r for r in rows if r[0] == actor), key=lambda r: r[1]):
            out += [(actor, x) for x in m.take(entry(r) | {"row": r})]
    return out


@pytest.mark.parametrize("name", SPECS)
def test_batch_agrees_with_the_matcher(spark, name):
    spec = SPECS[name]
    rows = [(f"{seed}{r[0]}", *r[1:]) for seed in range(12) for r in random_rows(seed)]
    want = expected(spec, rows)
    got = detect(spec, journal(spark, rows).repartition(3)).collect()
    names = sorted({n for r in got for n in r.asDict()} - {"actor", "levels", "chain", "trigger_entry_id", "trigger_at"})
    assert sorted((r["actor"], *key(r, names)) for r in got) == sorted((actor, *key(m, names)) for actor, m in want)
    assert got or name == "none_not_final"


@pytest.mark.parametrize("text", ["(m, k) in $ms × $ks", "(m, k) in ($ms, $ks)"])
@pytest.mark.parametrize("aged", [None, timedelta(minutes=15)])
def test_coverage(spark, text, aged):
    rows = [(f"{seed}{r[0]}", *r[1:]) for seed in range(12) for r in random_rows(seed, 80)]
    df = spark.createDataFrame(rows, "actor string, entry_id long, occurred_at timestamp_ntz, member string, k int, receiver string")
    anchors = df.where("member = 'c'").select("actor", "entry_id", "occurred_at", F.array(F.lit("a"), F.lit("b")).alias("ms"), F.array(F.lit(0), F.lit(1)).alias("ks"))
    legs = df.where("member <> 'c'").select("actor", "entry_id", "occurred_at", F.col("member").alias("m"), (F.col("k") % 2).alias("k"))
    spec = reaction("r").seek(source=anchors).then_final_seek(source=legs).many().within(30).cover(text)
    spec = spec.aged(aged) if aged else spec
    finders = [lambda e: {"ms": ["a", "b"], "ks": [0, 1]} if e["row"][3] == "c" else None, lambda e: {"m": e["row"][3], "k": e["row"][4] % 2} if e["row"][3] != "c" else None]
    want = expected(spec, rows, finders)
    got = detect(spec, journal(spark, rows)).collect()
    short = lambda m: (m["levels"][0], tuple(m["chain"]), m["trigger_entry_id"])
    assert got and sorted((r["actor"], *short(r)) for r in got) == sorted((x, *short(m)) for x, m in want)


def test_coverage_behind_a_leg(spark):
    rows = [(f"{seed}{r[0]}", *r[1:]) for seed in range(12) for r in random_rows(seed, 80)]
    df = spark.createDataFrame(rows, "actor string, entry_id long, occurred_at timestamp_ntz, member string, k int, receiver string")
    anchors = df.where("member = 'c' AND k < 2").select("actor", "entry_id", "occurred_at", F.array(F.lit(0), F.lit(1), F.lit(2)).alias("ks"))
    between = df.where("member = 'b'").select("actor", "entry_id", "occurred_at", F.col("k").alias("y"))
    legs = df.where("member = 'a'").select("actor", "entry_id", "occurred_at", "k")
    spec = reaction("r").seek(source=anchors).then_seek(source=between).within(9).then_final_seek(source=legs).many().within(20).cover("(k) in $ks")
    finders = [lambda e: {"ks": [0, 1, 2]} if e["row"][3] == "c" and e["row"][4] < 2 else None, lambda e: {"y": e["row"][4]} if e["row"][3] == "b" else None, lambda e: {"k": e["row"][4]} if e["row"][3] == "a" else None]
    short = lambda m: (tuple(m["levels"]), tuple(m["chain"]), m["trigger_entry_id"])
    got = detect(spec, journal(spark, rows)).collect()
    assert got and sorted((r["actor"], *short(r)) for r in got) == sorted((x, *short(m)) for x, m in expected(spec, rows, finders))


def test_edges(spark):
    assert detect(SPECS["pair"], journal(spark, [("u", 1, T0, "a", 0, "r")])).count() == 0
    exact = a().then_final_seek("[User].b(_)").none().within(2)
    base = [("u", 1, T0, "a", 0, "r"), ("u", 3, T0, "c", 0, "r")]
    assert detect(exact, journal(spark, base)).count() == 0  # ends within the window
    assert detect(exact, journal(spark, [*base, ("u", 4, T0, "c", 0, "r")])).first().trigger_entry_id == 4
    assert detect(exact, journal(spark, [*base, ("u", 4, T0, "b", 0, "r")])).count() == 1  # behind the window


def test_definitions_are_checked():
    for bad in (
        lambda: a().then_seek("[User].b(_)").none().check(), lambda: reaction("r").then_seek("[User].a(_)"), lambda: a().seek("[User].b(_)"),
        lambda: a().then_final_seek("[User].b(_)").then_seek("[User].c(_)"), lambda: a().exactly(1), lambda: parse_for_each("(a, b) in $x"),
        lambda: a().many().exactly(2), lambda: reaction("r").check(),
    ):
        with pytest.raises(ValueError):
            bad()
    assert SPECS["pair"].identity != SPECS["pair"].where("x != y").identity


def test_increasing_vectors_against_a_loop(spark):
    r = random.Random(4)
    rows = [("u", [r.randrange(5), r.randrange(5)], i) for i in range(200)]
    df = spark.createDataFrame(rows, "actor string, levels array<long>, trigger_entry_id long")
    best, want = [1, 2], []
    for _, v, i in rows:
        if v > best:
            best = v
            want.append(i)
    # The running maximum of all equals that of the accepted ones.
    assert [x.trigger_entry_id for x in accept_increasing(df, ["trigger_entry_id"], seed=[1, 2]).orderBy("trigger_entry_id").collect()] == want


def test_stream_restarts_without_refiring(spark, tmp_path):
    rows = [(f"{seed}{r[0]}", *r[1:]) for seed in range(2) for r in random_rows(seed, 80)]
    spec = SPECS["triple"]
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    whole = journal(spark, rows)
    halves = [r for i, r in enumerate(rows) if i < 70], [r for i, r in enumerate(rows) if i >= 70]
    for part in halves:
        journal(spark, part).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(whole.schema).parquet(str(src))
        q = detect_stream(spec, stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.actor, r.levels, r.trigger_entry_id) for r in spark.read.parquet(out).collect())
    assert got and got == sorted((x, ",".join(map(str, m["levels"])), m["trigger_entry_id"]) for x, m in expected(spec, rows))
