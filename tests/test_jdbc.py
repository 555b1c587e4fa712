"""Journals in a database: the embedded one that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from logloom.sources.jdbc import read_journal, write_journal


def test_round_trip(spark):
    url = f"jdbc:derby:memory:j{uuid.uuid4().hex};create=true"
    rows = [(i, "SCRIPT", f"x.f({i});", None, None, None) for i in range(1, 40)] + [(40, "DEFINE", None, 7, None, "define action 7 () as x.f(); end;"), (41, "INVOCATION", None, 7, "", None)]
    df = spark.createDataFrame(rows, "entry_id long, kind string, script string, action_id int, arguments string, define_text string").withColumn("occurred_at", F.expr("timestamp_ntz'2024-01-01 10:00:00.5' + make_dt_interval(0, 0, int(entry_id))"))
    jvm = spark.sparkContext._jvm
    link = jvm.java.sql.DriverManager.getConnection(url)
    link.createStatement().execute("CREATE TABLE diary (id BIGINT NOT NULL PRIMARY KEY, OccurredAt TIMESTAMP NOT NULL, Script CLOB, Action INT, Arguments CLOB, Skip SMALLINT NOT NULL)")
    assert read_journal(spark, url, "diary").count() == 0
    write_journal(df, url, "diary", elided=df.where("entry_id % 10 = 0 AND kind = 'SCRIPT'"))
    got = read_journal(spark, url, "diary", after=5, partitions=3)
    names = ["entry_id", "occurred_at", "kind", "script", "action_id", "arguments", "define_text"]
    want = df.where("entry_id > 5 AND NOT (entry_id % 10 = 0 AND kind = 'SCRIPT')").select(*names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))
    assert read_journal(spark, url, "diary", raw=True).count() == 41
    with pytest.raises(Exception, match="(?i)duplicate|key"):
        write_journal(df.limit(1), url, "diary")
    link.close()
