"""Journals as DataFrames: entry_id, occurred_at, actor, kind, calls, expose.

Tables enter directly as typed facts, so most queries need no script text and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOURNAL = T.StructType([
    T.StructField("entry_id", T.LongType(), False), T.StructField("occurred_at", T.TimestampNTZType(), False), T.StructField("kind", T.StringType()),
    T.StructField("script", T.StringType()), T.StructField("action_id", T.IntegerType()), T.StructField("arguments", T.StringType()),
    T.StructField("define_text", T.StringType()), T.StructField("expose", T.StringType()), T.StructField("actor", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def argument(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit(None).cast("string").alias("var_name"), F.lit(False).alias("is_out"))


def fact(pos: Column, node: str, receiver: Column, receiver_type: str, member: Column, *args: Column) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"), F.lit(node).alias("node"), receiver.cast("string").alias("receiver"), F.lit(receiver_type).alias("receiver_type"),
        F.array(F.lit(receiver_type.lower())).alias("supertypes"), member.cast("string").alias("member"), F.array(*args).alias("args"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of a journal with plain columns: entry_id, occurred_at, user_id, member, value, k, expose."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("entry_id"), F.col("ts").alias("occurred_at"), "user_id", F.col("event_type").alias("member"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").alias("expose"),
    )


def event_facts(rows: DataFrame) -> DataFrame:
    """rows of entries() with a fact each: [user_<id>:User].<type>(user_id, value, k)."""
    call = fact(F.lit(0), "call", F.concat(F.lit("user_"), F.col("user_id")), "User", F.col("member"), argument("long", F.col("user_id")), argument("double", F.col("value")), argument("int", F.col("k")))
    return rows.withColumn("calls", F.array(call))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream."""
    return event_facts(entries(spark, sf_dir)).withColumn("actor", F.lit(""))


def user_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each user: actor, and entry_id counted anew in each."""
    rows = entries(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("entry_id")).cast("long")
    return rows.withColumn("entry_id", place).withColumn("actor", F.col("user_id").cast("string"))


def user_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_facts(user_entries(spark, sf_dir))


def conversation_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each conversation: a fact for each turn, in order: [Chat].<role>(text, length)."""
    turns = table(spark, sf_dir, "conversations")
    one = fact(F.lit(0), "call", F.lit("chat"), "Chat", F.col("role"), argument("string", F.col("text")), argument("int", F.char_length("text")))
    calls = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("f")))), lambda x: F.struct(x["turn"].cast("int").alias("pos"), *[x["f"][n].alias(n) for n in ("node", "receiver", "receiver_type", "supertypes", "member", "args")]))
    grouped = turns.groupBy("conv_id").agg(calls.alias("calls"))
    return grouped.select((F.col("conv_id") + 1).alias("entry_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("occurred_at"), F.lit("").alias("actor"), "calls")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as script text, one statement an entry: user_<id>.<type>(value, k);"""
    text = F.concat(F.lit("user_"), F.col("user_id"), F.lit("."), F.col("member"), F.lit("("), F.col("k"), F.lit(", '"), F.col("member"), F.lit("');"))
    return entries(spark, sf_dir).withColumn("script", text).withColumn("actor", F.lit(""))


#: Literals that a script's skeleton leaves out: strings, and plain whole numbers that are no part of a name, date or fraction.
_STRINGS = r"'(?:[^'\\]|\\.)*'"
_WHOLE = r"(?<![A-Za-z_0-9#@$./:])(?:0|[1-9][0-9]{0,8})(?![A-Za-z_0-9#@./:])"
#: What stands for them, before their number.
_STRING_MARK, _WHOLE_MARK = "\x01", "\x02"
#: What a skeleton begins with; no script does.
_SKELETON = "\x03"


def skeleton(script: Column) -> Column:
    """A script with marks in place of its strings and whole numbers; texts with comments, lists of literals or scripts in
    strings stay as they are."""
    bare = F.regexp_replace(F.regexp_replace(script, _STRINGS, f"'{_STRING_MARK}'"), _WHOLE, f"'{_WHOLE_MARK}'")
    odd = F.contains(script, F.lit("//")) | F.contains(script, F.lit("/*")) | script.rlike(f"(?i)eval|[(,=]\\s*\\{{|[{_STRING_MARK}{_WHOLE_MARK}]")
    return F.when(odd, F.ltrim(script, F.lit(_SKELETON))).otherwise(F.concat(F.lit(_SKELETON), bare))


def skeleton_literals(script: Column) -> Column:
    """What skeleton() takes out, in order: strings without quotes and escapes, numbers as they are."""
    found = F.regexp_extract_all(script, F.lit(f"({_STRINGS}|{_WHOLE})"), F.lit(1))
    bare = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\([\\'])", "$1")
    return F.transform(found, lambda x: F.when(F.startswith(x, F.lit("'")), bare(x)).otherwise(x))


def parse_scripts(rows: DataFrame, types: dict[str, list[str]] | None = None, variables: dict[str, str] | None = None, script: str = "script", prefixes: dict[str, str] | None = None) -> DataFrame:
    """rows with calls, the facts of their scripts.  Scripts that differ in literals only are parsed once, as one skeleton whose
    literals are filled in as columns; texts that do not parse have no calls."""
    import re

    import pyarrow as pa

    from logloom.lang import facts as L
    from logloom.lang.syntax import SyntaxFault

    marks = re.compile(f"'([{_STRING_MARK}{_WHOLE_MARK}])'")

    def number(arg: dict) -> dict:
        """The argument with the type that its mark stands for."""
        return {**arg, "type": "int"} if (arg["value"] or "").lstrip("-").startswith(_WHOLE_MARK) else arg

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("node", pa.string()), ("receiver", pa.string()), ("receiver_type", pa.string()), ("supertypes", pa.list_(pa.string())), ("member", pa.string()), ("args", pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("var_name", pa.string()), ("is_out", pa.bool_())])))]))
        for b in batches:
            out = []
            for s in b.column(0).to_pylist():
                bare, count = s.startswith(_SKELETON), iter(range(len(s)))
                try:
                    text = marks.sub(lambda m, count=count: f"'{m[1]}{next(count)}'", s[1:]) if bare else s
                    found = L.facts(text, types=types, variables=variables, prefixes=prefixes)
                    out.append([{**f, "args": [number(a) for a in f["args"]]} for f in found] if bare else found)
                except SyntaxFault:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["__skeleton", "calls"])

    keyed = rows.withColumn("__skeleton", skeleton(F.col(script)))
    distinct = keyed.select("__skeleton").where(F.col("__skeleton").isNotNull()).distinct()
    parsed = distinct.mapInArrow(run, f"__skeleton string, calls array<{L.FACT}>").withColumnRenamed("__skeleton", "__parsed")
    joined = keyed.join(parsed, keyed["__skeleton"] == parsed["__parsed"], "left").withColumn("__literals", skeleton_literals(F.col(script)))

    def filled(a: Column) -> Column:
        mark = F.regexp_extract(a["value"], f"^(-?)[{_STRING_MARK}{_WHOLE_MARK}]([0-9]+)$", 2)
        value = F.concat(F.when(F.startswith(a["value"], F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.get(F.col("__literals"), mark.cast("int")))
        value = F.when(F.startswith(F.col("__skeleton"), F.lit(_SKELETON)) & a["value"].rlike(f"^-?[{_STRING_MARK}{_WHOLE_MARK}][0-9]+$"), value).otherwise(a["value"])
        return F.struct(a["type"].alias("type"), value.alias("value"), a["var_name"].alias("var_name"), a["is_out"].alias("is_out"))

    whole = lambda f: F.struct(*[f[n].alias(n) for n in ("pos", "node", "receiver", "receiver_type", "supertypes", "member")], F.transform(f["args"], filled).alias("args"))
    return joined.withColumn("calls", F.transform("calls", whole)).drop("__skeleton", "__parsed", "__literals")
