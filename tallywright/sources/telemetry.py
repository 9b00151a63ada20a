"""Telemetry ingest: validation into accepted and rejected rows, promoted columns, series rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.session import load

MAX_NAME, MAX_ATTRIBUTES = 256, 256


def metric_defect(c=F.col) -> Column:
    """Why a metric point is refused, or NULL."""
    exp = c("exponential_scale").isNotNull() | c("positive_buckets").isNotNull() | c("negative_buckets").isNotNull()
    buckets = c("bucket_counts").isNotNull() | c("explicit_bounds").isNotNull()
    kind = c("metric_type")
    number = c("int_value").isNotNull() | c("double_value").isNotNull()
    quantiles = c("quantile_values")
    return (
        F.when(F.exists("exemplars", lambda e: e.span_id.isNotNull() & e.trace_id.isNull()), "exemplar span without trace")
        .when(kind.isin("gauge", "sum") & ~number, "value missing")
        .when((kind == "histogram") & c("histogram_count").isNull(), "count missing")
        .when((kind == "histogram") & (F.size("bucket_counts") != F.size("explicit_bounds") + 1) & c("bucket_counts").isNotNull() & c("explicit_bounds").isNotNull(), "bucket counts do not fit bounds")
        .when((kind == "histogram") & (exp | quantiles.isNotNull()), "foreign fields")
        .when((kind == "exponential_histogram") & (c("histogram_count").isNull() | c("exponential_scale").isNull()), "count or scale missing")
        .when((kind == "exponential_histogram") & (buckets | quantiles.isNotNull()), "foreign fields")
        .when((kind == "summary") & (c("summary_count").isNull() | quantiles.isNull() | (F.size(quantiles) == 0)), "count or quantiles missing")
        .when((kind == "summary") & F.exists(F.coalesce(quantiles, F.array().cast("array<struct<quantile:double,value:double>>")), lambda q: (q.quantile < 0) | (q.quantile > 1) | q.quantile.isNull()), "quantile out of range")
        .when((kind == "summary") & buckets, "foreign fields")
        .when(~kind.isin("gauge", "sum", "histogram", "exponential_histogram", "summary") | kind.isNull(), "unknown type")
    )


def span_defect(c=F.col) -> Column:
    """Why a span is refused, or NULL."""
    return (
        F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "empty name")
        .when(F.length("name") > MAX_NAME, "long name")
        .when(c("end_time_unix_nano") < c("start_time_unix_nano"), "end before start")
        .when(c("duration_nano") != c("end_time_unix_nano") - c("start_time_unix_nano"), "duration differs")
        .when(F.length("trace_id") != 16, "bad trace id")
        .when(F.length("span_id") != 8, "bad span id")
    )


def partial_success(rows: DataFrame, defect: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason); whole rows only.

    With ``order`` the accepted rows keep their place in the request and get
    contiguous ordinals.
    """
    marked = rows.withColumn("_defect", defect)
    good, bad = marked.where("_defect is null").drop("_defect"), marked.where("_defect is not null").withColumnRenamed("_defect", "reason")
    if order:
        from pyspark.sql import Window

        good = good.withColumn("ordinal", F.row_number().over(Window.partitionBy("request_id").orderBy(order)) - 1)
    return good, bad


#: Promoted attribute columns of spans and logs, by attribute key and type.
PROMOTED = {
    "gen_ai_operation_name": ("gen_ai.operation.name", "string"),
    "gen_ai_provider_name": ("gen_ai.provider.name", "string"),
    "gen_ai_request_model": ("gen_ai.request.model", "string"),
    "gen_ai_conversation_id": ("gen_ai.conversation.id", "string"),
    "gen_ai_usage_input_tokens": ("gen_ai.usage.input_tokens", "bigint"),
    "gen_ai_usage_output_tokens": ("gen_ai.usage.output_tokens", "bigint"),
    "http_request_method": ("http.request.method", "string"),
    "http_route": ("http.route", "string"),
    "http_response_status_code": ("http.response.status_code", "bigint"),
    "url_full": ("url.full", "string"),
    "url_path": ("url.path", "string"),
    "url_query": ("url.query", "string"),
    "exception_type": ("exception.type", "string"),
    "exception_message": ("exception.message", "string"),
    "exception_stacktrace": ("exception.stacktrace", "string"),
}
SCHEMA_OF = {"string": "STRING", "bigint": "BIGINT"}


def typed(variant: Column, key: str, kind: str) -> Column:
    """The attribute if it is there with this very type, else NULL."""
    path = f'$["{key}"]'
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(value) == SCHEMA_OF[kind], F.try_variant_get(variant, path, kind))


def promote(rows: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Promoted columns from a variant; a supplied value that differs from its source raises."""
    out = {}
    for column, (key, kind) in PROMOTED.items():
        own = typed(F.col(attributes), key, kind)
        if column in rows.columns:
            given = F.col(column)
            own = F.when(given.isNotNull() & ~given.eqNullSafe(own), F.raise_error(F.lit(f"{column} differs from its source"))).otherwise(own)
        out[column] = own
    return rows.withColumns(out)


def span_is_exception(events: str = "events") -> Column:
    return F.exists(events, lambda e: e["name"] == "exception")


def log_is_exception() -> Column:
    """A promoted exception text is there, an empty one included; severity does not count."""
    return F.col("exception_type").isNotNull() | F.col("exception_message").isNotNull() | F.col("exception_stacktrace").isNotNull()


def log_columns(rows: DataFrame) -> DataFrame:
    """body_text for text bodies only, and event_name NULL when empty."""
    return rows.withColumns({"body_text": F.when(F.schema_of_variant("body") == "STRING", F.try_variant_get("body", "$", "string")), "event_name": F.nullif(F.col("event_name"), F.lit(""))})


def series_rows(points: DataFrame) -> DataFrame:
    """One row for each series and hour, to be written before the points."""
    hour = F.date_trunc("hour", F.col("time"))
    return points.select("series_id", "metric_name", "metric_type", "unit", hour.alias("hour"), "service_name").dropDuplicates(["series_id", "hour", "service_name"])


# --- OTLP JSON -------------------------------------------------------------
#: The JSON form of an export request of spans, as far as it is read.
VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
ATTRIBUTE = f"struct<key:string,value:{VALUE}>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,flags:bigint,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<{ATTRIBUTE}>,droppedAttributesCount:bigint,events:array<struct<timeUnixNano:string,name:string>>,status:struct<code:int,message:string>>"
REQUEST = f"resourceSpans array<struct<resource:struct<attributes:array<{ATTRIBUTE}>>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{SPAN}>>>>>"


def otlp_spans(requests: DataFrame, body: str = "body") -> DataFrame:
    """Spans of export requests (request_id and JSON text), in request order; a body that cannot be read gives one row without a name."""
    got = requests.select("request_id", F.from_json(body, REQUEST).alias("r"))
    flat = got.select("request_id", F.posexplode_outer("r.resourceSpans").alias("i", "rs")).select("request_id", "i", F.col("rs.resource.attributes").alias("resource"), F.posexplode_outer("rs.scopeSpans").alias("j", "ss"))
    flat = flat.select("request_id", "i", "j", "resource", F.col("ss.scope.name").alias("scope_name"), F.posexplode_outer("ss.spans").alias("k", "s"))
    start, end = F.try_to_number("s.startTimeUnixNano", F.lit("9" * 19)).cast("long"), F.try_to_number("s.endTimeUnixNano", F.lit("9" * 19)).cast("long")
    return flat.select(
        "request_id",
        F.struct("i", "j", "k").alias("place"),
        F.unhex("s.traceId").alias("trace_id"),
        F.unhex("s.spanId").alias("span_id"),
        F.unhex("s.parentSpanId").alias("parent_span_id"),
        F.col("s.name").alias("name"),
        F.coalesce("s.kind", F.lit(0)).alias("kind"),
        start.alias("start_time_unix_nano"),
        end.alias("end_time_unix_nano"),
        (end - start).alias("duration_nano"),
        F.col("s.status.code").alias("status_code"),
        attribute_json("s.attributes").alias("attributes"),
        attribute_json("resource").alias("resource_attributes"),
        "scope_name",
        F.exists(F.coalesce("s.events", F.array().cast("array<struct<timeUnixNano:string,name:string>>")), lambda e: e["name"] == "exception").alias("is_exception"),
    )


def attribute_json(column: str) -> Column:
    """A list of keys and typed values as a variant object; a key that repeats keeps its last value."""

    def text(v: Column) -> Column:
        quoted = F.to_json(F.array(v["stringValue"]))
        return F.coalesce(F.when(v["stringValue"].isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), v["intValue"], v["boolValue"].cast("string"), F.when(v["doubleValue"].isNotNull(), v["doubleValue"].cast("string")), F.lit("null"))

    def member(a: Column) -> Column:
        key = F.to_json(F.array(a["key"]))
        return F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(":"), text(a["value"]))

    listed = F.coalesce(F.col(column), F.array().cast(f"array<{ATTRIBUTE}>"))
    last = F.filter(listed, lambda a, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda b: b["key"] == a["key"]))
    return F.try_parse_json(F.concat(F.lit("{"), F.array_join(F.transform(last, member), ","), F.lit("}")))


# --- queries ---------------------------------------------------------------
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as export requests, one for each user; some spans are defective."""
    ev = load(spark, sf_dir, "events")
    text = F.lit(None).cast("string")

    def attribute(key: str, kind: str, value: Column) -> Column:
        parts = {"stringValue": text, "boolValue": F.lit(None).cast("boolean"), "intValue": text, "doubleValue": F.lit(None).cast("double")} | {kind: value}
        return F.struct(F.lit(key).alias("key"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("value"))

    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    size = F.when(F.col("event_id") % 13 == 0, -1).otherwise(F.col("event_id") * 10)
    span = F.struct(
        F.lpad(F.hex("user_id"), 32, "0").alias("traceId"),
        F.lpad(F.hex("event_id"), F.when(F.col("event_id") % 17 == 0, 14).otherwise(16), F.lit("0")).alias("spanId"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).otherwise("").alias("name"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + size).cast("string").alias("endTimeUnixNano"),
        F.array(attribute("http.route", "stringValue", F.concat(F.lit('/"x"/'), "event_type")), attribute("http.response.status_code", "intValue", F.col("event_id").cast("string")), attribute("url.path", "boolValue", F.col("event_id") % 2 == 0)).alias("attributes"),
        F.array(F.struct(F.lit("0").alias("timeUnixNano"), F.when(F.col("event_type") == "error", "exception").otherwise("note").alias("name"))).alias("events"),
    )
    rows = ev.groupBy(F.col("user_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", span.alias("s")))).alias("l"))
    scope = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.transform("l", lambda x: x["s"]).alias("spans"))
    return rows.select("request_id", F.to_json(F.struct(F.array(F.struct(F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("body"))


def otlp_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected spans of every request."""
    good, bad = partial_success(otlp_spans(_requests(spark, sf_dir)), span_defect(), "place")
    rows = good.select("request_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("request_id", F.col("reason").alias("outcome")))
    return rows.groupBy("request_id", "outcome").agg(F.count("*").alias("n"))


def otlp_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted spans in request order, with promoted columns; a boolean path is no text."""
    good, _ = partial_success(otlp_spans(_requests(spark, sf_dir)), span_defect(), "place")
    out = promote(good)
    return out.select(F.conv(F.hex("span_id"), 16, 10).cast("long").alias("event_id"), F.col("ordinal").cast("long").alias("ordinal"), "name", "duration_nano", "http_route", "http_response_status_code", "url_path", "is_exception")


def metric_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all types from events, some of them defective, by type and reason."""
    k = F.col("event_id")
    kinds = F.element_at(F.array(*map(F.lit, ("gauge", "sum", "histogram", "exponential_histogram", "summary", "odd"))), (k % 6 + 1).cast("int"))
    q = F.array(F.struct(F.when(k % 4 == 0, 1.5).otherwise(0.5).alias("quantile"), F.col("value").alias("value")))
    p = load(spark, sf_dir, "events").select(
        kinds.alias("metric_type"),
        F.lit(None).cast("bigint").alias("int_value"),
        F.when(k % 6 < 2, F.when(k % 5 != 0, F.col("value"))).alias("double_value"),
        F.when((k % 6).isin(2, 3), k).alias("histogram_count"),
        F.when(k % 6 == 2, F.array(k, k)).alias("bucket_counts"),
        F.when(k % 6 == 2, F.when(k % 7 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))).alias("explicit_bounds"),
        F.when((k % 6 == 3) & (k % 5 != 0), F.lit(2)).alias("exponential_scale"),
        F.lit(None).cast("struct<offset:int,bucket_counts:array<bigint>>").alias("positive_buckets"),
        F.lit(None).cast("struct<offset:int,bucket_counts:array<bigint>>").alias("negative_buckets"),
        F.when(k % 6 == 4, k).alias("summary_count"),
        F.when(k % 6 == 4, q).alias("quantile_values"),
        F.array().cast("array<struct<span_id:binary,trace_id:binary>>").alias("exemplars"),
    )
    good, bad = partial_success(p, metric_defect())
    rows = good.select("metric_type", F.lit("accepted").alias("outcome")).unionByName(bad.select("metric_type", F.col("reason").alias("outcome")))
    return rows.groupBy("metric_type", "outcome").agg(F.count("*").alias("n"))


def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series rows of events as points."""
    p = load(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.lit("m").alias("metric_name"), F.lit("gauge").alias("metric_type"), F.lit("1").alias("unit"), F.col("ts").alias("time"), F.col("event_type").alias("service_name"))
    return series_rows(p).select("series_id", "hour", "service_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (otlp_outcomes, otlp_accepted, metric_outcomes, series_index)}
_DEFECT = "CASE WHEN event_id % 11 = 0 THEN 'empty name' WHEN event_id % 13 = 0 THEN 'end before start' WHEN event_id % 17 = 0 THEN 'bad span id' ELSE 'accepted' END"
ORACLE_SQL: dict[str, str] = {
    "otlp_outcomes": f"SELECT user_id AS request_id, {_DEFECT} AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "otlp_accepted": f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_type AS name, event_id * 10 AS duration_nano, '/\"x\"/' || event_type AS http_route, event_id AS http_response_status_code, CAST(NULL AS VARCHAR) AS url_path, event_type = 'error' AS is_exception FROM events WHERE {_DEFECT} = 'accepted'",
    "metric_outcomes": "SELECT ['gauge', 'sum', 'histogram', 'exponential_histogram', 'summary', 'odd'][event_id % 6 + 1] AS metric_type, CASE WHEN event_id % 6 < 2 AND event_id % 5 = 0 THEN 'value missing' WHEN event_id % 6 = 2 AND event_id % 7 = 0 THEN 'bucket counts do not fit bounds' WHEN event_id % 6 = 3 AND event_id % 5 = 0 THEN 'count or scale missing' WHEN event_id % 6 = 4 AND event_id % 4 = 0 THEN 'quantile out of range' WHEN event_id % 6 = 5 THEN 'unknown type' ELSE 'accepted' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "series_index": "SELECT DISTINCT user_id AS series_id, date_trunc('hour', ts) AS hour, event_type AS service_name FROM events",
}
