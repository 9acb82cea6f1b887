import duckdb
import pytest

from lexloom.plans import answers, more, queries, stores

QUERIES, SQL = queries.QUERIES | more.QUERIES | answers.QUERIES | stores.QUERIES, queries.SQL | more.SQL | answers.SQL | stores.SQL

DATA = "/root/testdata/sf0.01"
TABLES = "documents pages benchmark embeddings conversations events".split()


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(c.sql(SQL[name]).df())


def test_document_symbols(spark):
    from pyspark.sql import functions as F

    from lexloom.functions.text import question_symbols

    df = spark.createDataFrame([("use std::vec and os.path or os.path a_b x.",), (None,)], "t string")
    got = [r[0] for r in df.select(question_symbols(F.col("t"))).collect()]
    assert got == [["std::vec", "os.path", "a_b"], None]


def test_paragraphs(spark):
    from pyspark.sql import functions as F

    from lexloom.functions.text import paragraphs

    df = spark.createDataFrame([(" a \n  b\n \n\n c\n",), ("",), (None,), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(paragraphs(F.col("t"))).collect()] == [["a\nb", "c"], [], [], []]


def test_streams_as_batches(spark, tmp_path):
    from lexloom.operators.tables import latest
    from lexloom.sources.tables import table
    from lexloom.streaming.sessions import latest_stream

    events = table(spark, DATA, "events").select("user_id", "ts", "event_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = latest_stream(stream, "user_id", ["ts", "event_id"]).writeStream.format("memory").queryName("last_rows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert rows(spark.table("last_rows").toPandas()) == rows(latest(events, "user_id", ["ts", "event_id"]).toPandas())


def test_session_stream_as_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexloom.operators.tables import idle_sessions
    from lexloom.streaming.sessions import session_stream

    rows = [(1, m * 60) for m in (0, 14, 29, 44, 100)] + [(2, 5), (2, 15 * 60 + 4), (2, 30 * 60 + 4), (9, 10**6)]
    events = spark.createDataFrame(rows, "user_id bigint, s bigint").select("user_id", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = session_stream(stream, "user_id", "ts", "0 seconds").writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    late = idle_sessions(events.filter("user_id < 9"), "user_id", "ts").select("user_id", F.col("started").alias("start"), "n_events")
    assert rows_of(spark.table("idle").filter("user_id < 9")) == rows_of(late)


def rows_of(df):
    return rows(df.toPandas())
