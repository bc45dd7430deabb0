import pytest
from pyspark.sql import functions as F

from tallypost.functions import codec, names
from tallypost.operators import changes as C

NOW = "2024-05-01 00:00:00"


def decoded(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    p = codec.parse_message(F.col("value"), now=F.lit(NOW).cast("timestamp"))
    row = df.select(F.explode(F.array(p)).alias("p")).select(
        "p.ok", "p.value.id", "p.value.content", F.col("p.value.created_at").cast("string").alias("at"),
        F.col("p.value").isNull().alias("nothing"),
    ).first()
    return None if not row["ok"] else ("null" if row["nothing"] else (row["id"], row["content"], row["at"]))


AT = "2024-01-02 03:04:05.123456"


@pytest.mark.parametrize("text, want", [
    ('{"id":7,"content":"a","createdAt":"2024-01-02T03:04:05.1234567Z"}', (7, "a", AT)),
    ('{"ID":7,"Content":"a","CREATEDAT":"2024-01-02T03:04:05.123456Z"}', (7, "a", AT)),
    ('{"id":"7","content":"a","createdAt":"2024-01-02T03:04:05.123456Z","extra":[1]}', (7, "a", AT)),
    ('{"id":7,"content":null,"createdAt":"2024-01-02T03:04:05.123456Z"}', (7, None, AT)),
    ('{"id":7,"createdAt":"2024-01-02T03:04:05.123456Z"}', (7, "", AT)),
    ('{}', (0, "", NOW)),
    ('{"id":-7}', (-7, "", NOW)),
    (None, "null"),
    ("null", "null"),
    ('{"id":7.5}', None),
    ('{"id":" 7"}', None),
    ('{"id":99999999999}', None),
    ('{"id":null}', None),
    ('{"id":true}', None),
    ('{"createdAt":"soon"}', None),
    ('{"id":7', None),
    ("[]", None),
    ("7", None),
    ("", None),
])
def test_message_json(spark, text, want):
    assert decoded(spark, text) == want


def image(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    row = C.decode_envelopes(df).select(
        "malformed", "after.id", "after.content", F.col("after.created_at").cast("string").alias("at"),
        F.col("after").isNull().alias("nothing"),
    ).first()
    return None if row["malformed"] else ("none" if row["nothing"] else (row["id"], row["content"], row["at"]))


@pytest.mark.parametrize("text, want", [
    ('{"op":"c","after":{"id":1,"content":"x","created_at":"2024-01-02T03:04:05.123456Z","n":1}}', (1, "x", AT)),
    ('{"AFTER":{"Id":1,"CONTENT":"x","Created_At":"2024-01-02T03:04:05.123456Z"}}', (1, "x", AT)),
    ('{"op":"d","after":null}', "none"),
    ('{"op":"d"}', "none"),
    ("null", "none"),
    ('{"after":{"id":1}}', (1, "", "0001-01-01 00:00:00")),
    ('{"after":{"id":"1","content":"x","created_at":"2024-01-02T03:04:05.123456Z"}}', None),
    ('{"after":5}', None),
    ("{broken", None),
])
def test_envelope(spark, text, want):
    assert image(spark, text) == want


def test_long_text_is_kept_whole(spark):
    content = "ü\"\\\n" * 50_000
    df = spark.createDataFrame([(1, content)], "id int, content string").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    good, bad = codec.split_malformed(codec.decode_records(codec.encode_records(df)))
    assert bad.count() == 0
    assert good.select("message.content").first()[0] == content


def test_keys_round_trip_and_wrong_lengths(spark):
    ids = [0, 1, 255, 256, 2**31 - 1, -1, -(2**31)]
    df = spark.createDataFrame([(i,) for i in ids], "id int").select("id", codec.key_bytes(F.col("id")).alias("k"))
    for r in df.select("id", "k", codec.key_int(F.col("k")).alias("back")).collect():
        assert bytes(r["k"]) == r["id"].to_bytes(4, "big", signed=True) and r["back"] == r["id"]
    odd = spark.sql("select X'00' as k union all select X'0000000001' union all select cast(null as binary)")
    assert [r[0] for r in odd.select(codec.key_int(F.col("k"))).collect()] == [None] * 3


def test_one_parse_per_envelope(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("value"))
    plan = C.cdc_after_image(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_names():
    assert names.camel("next_retry_at") == "nextRetryAt" and names.snake("nextRetryAt") == "next_retry_at"
    assert names.snake("Id") == "id" and names.camel("id") == "id"


def test_project_by_name_ignores_order_and_fills_gaps(spark):
    rows = spark.createDataFrame([("x", 9, 1)], "content string, other int, id int")
    r = C.project_by_name(rows, now=F.lit(NOW).cast("timestamp")).select("id", "content", F.col("created_at").cast("string")).first()
    assert tuple(r) == (1, "x", NOW)
    r = C.project_by_name(rows.select("other"), now=F.lit(NOW)).first()
    assert tuple(r) == (0, "", NOW)


def test_snapshot_rows_go_tombstones_stay(spark):
    df = spark.createDataFrame([('{"op":"r"}',), ('{"op":"c"}',), (None,), ('{"x":1}',)], "value string")
    assert C.skip_snapshot(df).count() == 3


def test_position_counts_every_kind(spark):
    df = spark.createDataFrame([(10, "insert"), (30, "commit"), (20, "insert")], "wal_end long, kind string")
    assert tuple(C.acknowledged_position(df).first()) == (30, 20)
