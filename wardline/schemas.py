"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

CONTEXT = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("priority", T.StringType()),
    T.StructField("timeout", T.DoubleType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("guardrail", T.StringType()),
    T.StructField("context", CONTEXT),
    T.StructField("cache_ttl", T.IntegerType()),
    T.StructField("skip_cache", T.BooleanType()),
])

BATCHES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("contexts", T.ArrayType(T.StringType())),
    T.StructField("guardrail", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

POLICY_CHECKS = T.StructType([
    T.StructField("guardrail", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("validator", T.StringType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("on_fail", T.StringType()),
])

VALIDATOR_RESULT = T.StructType([
    T.StructField("validator_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("on_fail_action", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("redacted_text", T.StringType()),
    T.StructField("model_version", T.StringType()),
])

# what a model plug-in returns for one text
LABEL_SCORES = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

LOG_LINE = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("valid", T.BooleanType()),
    T.StructField("execution_time_ms", T.DoubleType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("cache_key", T.StringType()),
])

SPANS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("logs", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]))),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
])
