"""Schemas of the stored tables and of the records on the wire."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

OUTBOX = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type_name", T.StringType(), False),
    T.StructField("payload", T.BinaryType(), False),
    T.StructField("status", T.IntegerType(), False),
    T.StructField("retry_count", T.IntegerType(), False),
    T.StructField("next_retry_at", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("processed_at", T.TimestampType(), True),
    T.StructField("dead_letter_error", T.StringType(), True),
])

# What a dispatch try leaves in the attempt log.
ATTEMPT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("attempt_no", T.IntegerType(), False),
    T.StructField("attempted_at", T.TimestampType(), False),
    T.StructField("ok", T.BooleanType(), False),
    T.StructField("error", T.StringType(), True),
])

# The columns of Spark's Kafka source that the operators use; files in the same
# shape stand in for a broker.
TOPIC_RECORD = T.StructType([
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("offset", T.LongType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
])

CHANGE = T.StructType([
    T.StructField("wal_end", T.LongType(), False),
    T.StructField("relation", T.StringType(), True),
    T.StructField("kind", T.StringType(), False),
    T.StructField("id", T.IntegerType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

# A posted body may carry more fields; only the content is taken from the client.
INGEST_BODY = T.StructType([T.StructField("content", T.StringType(), True)])

# Names, limits and defaults shared with the systems on both sides.
MESSAGE_TOPIC = "messages"
MESSAGE_TABLE = "messages"
CDC_TOPIC = "cdc.public.messages"
CDC_PREFIX = "cdc"
CDC_SCHEMA = "public"
CONSUMER_GROUP = "my-group"
CDC_CONSUMER_GROUP = "debezium-consumer"
TYPE_NAME = "Message"
TYPE_NAME_LIMIT = 256
OUTBOX_POLL = "100 milliseconds"
OUTBOX_BATCH = 50
OUTBOX_MAX_ATTEMPTS = 3
HIDDEN_PATHS = ("/health", "/alive")
FAILED_RATE_LIMIT = 0.01

# Outbox status codes.
OPEN, DONE, DEAD = 0, 1, 2

# How long a write waits for its delivery before it counts as not confirmed.
WAIT_SECONDS = 60
