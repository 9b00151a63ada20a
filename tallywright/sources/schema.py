"""Table schemas: managed columns, names, fingerprints, layouts, alteration, and the built-in tables."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = "tally"
OWNED_BY_CALLERS = "datasets"
NAMESPACES = ("audit", "datasets", "drift", "gateway", "logs", "metrics", "storage", "system", "traces", "verification")

PRIMITIVES = {"string": T.StringType(), "bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "variant": T.VariantType()}


def ddl(text: str) -> T.StructType:
    """A schema from ``name type [NOT NULL], ...``, without a session."""
    return T.StructType([_column(c) for c in _split(text)])


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def _column(text: str) -> T.StructField:
    name, kind = text.split(None, 1)
    required = kind.upper().endswith(" NOT NULL")
    return T.StructField(name, _type(kind[: -len(" NOT NULL")] if required else kind), not required)


def _type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        pairs = (c.split(":", 1) for c in _split(text[7:-1]))
        return T.StructType([T.StructField(n.strip(), _type(k)) for n, k in pairs])
    return PRIMITIVES[text]


#: Columns that the server stamps, in order, after the table's own.
MANAGED = ddl("workload_card_uid string, subject_card_uid string, run_id string, sub_principal_id string NOT NULL, act_principal_id string NOT NULL, request_id string NOT NULL, ingested_at timestamp NOT NULL")
RESERVED_PREFIX = "tally_"
SHARED = "service_name string, service_version string, deployment_environment string, subject_kind string, subject_name string, subject_version string"


class SchemaError(ValueError):
    """The schema or the change to it is refused."""


def check_name(name: str) -> str:
    """A safe table name."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,63}", name) or ".." in name or name[0] == "." or name[-1] == ".":
        raise SchemaError(f"bad table name {name!r}")
    return name


def check_columns(schema: T.StructType) -> None:
    names = [f.name for f in schema.fields]
    if len({n.lower() for n in names}) < len(names):
        raise SchemaError("a column name appears twice")
    for n in names:
        if n in MANAGED.names or n.startswith(RESERVED_PREFIX):
            raise SchemaError(f"column name {n!r} is reserved")


def stamp(df: DataFrame, sub: str, act: str, request: str, workload: str | None = None, subject: str | None = None, run: str | None = None) -> DataFrame:
    """The rows with the managed columns appended."""
    values: dict[str, Column] = {"workload_card_uid": F.lit(workload).cast("string"), "subject_card_uid": F.lit(subject).cast("string"), "run_id": F.lit(run).cast("string"), "sub_principal_id": F.lit(sub), "act_principal_id": F.lit(act), "request_id": F.lit(request), "ingested_at": F.current_timestamp()}
    return df.select("*", *[values[f.name].alias(f.name) for f in MANAGED.fields])


def fingerprint(schema: T.StructType, exact: bool = False) -> str:
    """SHA-256 over ordered (name, type); exact also covers nested names and nullability.  Metadata never counts."""

    def plain(t: T.DataType):
        if isinstance(t, T.StructType):
            return ["struct", [[f.name, plain(f.dataType), f.nullable] if exact else [plain(f.dataType)] for f in t.fields]]
        if isinstance(t, T.ArrayType):
            return ["array", plain(t.elementType), *([t.containsNull] if exact else [])]
        if isinstance(t, T.MapType):
            return ["map", plain(t.keyType), plain(t.valueType), *([t.valueContainsNull] if exact else [])]
        return t.simpleString()

    body = [[f.name, plain(f.dataType), *([f.nullable] if exact else [])] for f in schema.fields]
    return hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """How files are arranged: partitions are exact UTC hours or days of the time column."""

    time_column: str = "ingested_at"
    partition_by: str = "day"
    sort_keys: tuple[str, ...] = ()
    bloom_columns: tuple[str, ...] = ()

    def partition(self) -> Column:
        return F.date_format(F.date_trunc(self.partition_by, F.col(self.time_column)), "yyyy-MM-dd-HH" if self.partition_by == "hour" else "yyyy-MM-dd")


@dataclass(frozen=True)
class Table:
    namespace: str
    name: str
    schema: T.StructType
    layout: Layout = Layout()
    sensitive: tuple[str, ...] = ()
    version: int = 1
    built_in: bool = False
    history: tuple[str, ...] = field(default=())

    @property
    def full_name(self) -> str:
        return f"{CATALOG}.{self.namespace}.{self.name}"

    @property
    def stored(self) -> T.StructType:
        return T.StructType(self.schema.fields + MANAGED.fields)


def alter(table: Table, expected_version: int, add: T.StructType | None = None, rename: dict[str, str] | None = None, layout: Layout | None = None) -> Table:
    """A new version: nullable columns added, columns renamed (the layout follows), layout changed."""
    if expected_version != table.version:
        raise SchemaError(f"the table is at version {table.version}")
    if table.built_in and (add or rename):
        raise SchemaError("built-in schemas are fixed")
    fields, lay = list(table.schema.fields), layout or table.layout
    for f in add.fields if add else []:
        if not f.nullable:
            raise SchemaError(f"new column {f.name!r} must be nullable")
        fields.append(f)
    rename = rename or {}
    if missing := set(rename) - {f.name for f in fields}:
        raise SchemaError(f"no column {sorted(missing)[0]!r}")
    fields = [T.StructField(rename.get(f.name, f.name), f.dataType, f.nullable) for f in fields]
    schema = T.StructType(fields)
    check_columns(schema)
    names = set(schema.names) | set(MANAGED.names)
    lay = replace(lay, time_column=rename.get(lay.time_column, lay.time_column), sort_keys=tuple(rename.get(k, k) for k in lay.sort_keys), bloom_columns=tuple(rename.get(k, k) for k in lay.bloom_columns))
    if not lay.partition_by:
        raise SchemaError("a table needs a partition")
    if bad := [c for c in (lay.time_column, *lay.sort_keys, *lay.bloom_columns) if c not in names]:
        raise SchemaError(f"the layout names no column {bad[0]!r}")
    return replace(table, schema=schema, layout=lay, version=table.version + 1, history=(*table.history, fingerprint(table.schema, True)))


# --- built-in tables -------------------------------------------------------
ENTITY = "array<struct<schema_url:string,type:string,id_keys:array<string>,description_keys:array<string>>>"
RESOURCE = f"resource_present boolean NOT NULL, resource_attributes variant NOT NULL, resource_dropped_attributes_count bigint NOT NULL, resource_schema_url string NOT NULL, resource_entity_refs {ENTITY} NOT NULL"
SCOPE = "scope_present boolean NOT NULL, scope_name string NOT NULL, scope_version string NOT NULL, scope_attributes variant NOT NULL, scope_dropped_attributes_count bigint NOT NULL, scope_schema_url string NOT NULL"
PROMOTED = "service_namespace string, service_instance_id string, process_pid bigint, telemetry_sdk_name string, telemetry_sdk_language string, telemetry_sdk_version string"
EXCEPTION = "exception_type string, exception_message string, exception_stacktrace string"


#: What files of the built-in tables are sorted by (the time column, unless named here) and have Bloom filters for.
SORTED = {"traces.spans": "start_time_unix_nano", "metrics.points": "time_unix_nano", "logs.records": "time_unix_nano"}
BLOOM = {
    "traces.spans": "trace_id",
    "metrics.points": "metric_name series_id",
    "logs.records": "trace_id",
    "drift.observations": "series",
    "gateway.calls": "call_id",
    "storage.objects": "storage_path sha256",
    "system.audit_log": "sub_principal_id act_principal_id request_id resource",
    "verification.results": "result_id execution_id verifier_card_uid binding_id group_id",
    "verification.approvals": "approval_id execution_id",
    "verification.execution_inputs": "execution_id verifier_card_uid binding_id group_id",
    "verification.execution_outputs": "result_id execution_id",
    "verification.execution_events": "event_id execution_id verifier_card_uid",
    "verification.evidence": "evidence_id commit verifier_card_uid",
}


def _table(namespace: str, name: str, columns: str, time: str, part: str = "day", sensitive: tuple[str, ...] = (), shared: bool = True) -> Table:
    schema = ddl(columns + (", " + SHARED if shared else ""))
    full = f"{namespace}.{name}"
    layout = Layout(time, part, (SORTED.get(full, time),), tuple(BLOOM.get(full, "").split()))
    return Table(namespace, name, schema, layout, sensitive, built_in=True)


BUILT_IN: dict[str, Table] = {
    t.full_name: t
    for t in (
        _table(
            "traces",
            "spans",
            "trace_id binary NOT NULL, span_id binary NOT NULL, parent_span_id binary, trace_state string NOT NULL, flags bigint NOT NULL, name string NOT NULL, kind int NOT NULL, start_time_unix_nano bigint NOT NULL, start_time timestamp NOT NULL, end_time_unix_nano bigint NOT NULL, duration_nano bigint NOT NULL, status_present boolean NOT NULL, status_code int, status_message string, attributes variant NOT NULL, dropped_attributes_count bigint NOT NULL, "
            "events array<struct<time_unix_nano:bigint,name:string,attributes:variant,dropped_attributes_count:bigint>> NOT NULL, dropped_events_count bigint NOT NULL, links array<struct<trace_id:binary,span_id:binary,trace_state:string,attributes:variant,dropped_attributes_count:bigint,flags:bigint>> NOT NULL, dropped_links_count bigint NOT NULL, "
            f"{RESOURCE}, {SCOPE}, gen_ai_operation_name string, gen_ai_provider_name string, gen_ai_request_model string, gen_ai_conversation_id string, gen_ai_usage_input_tokens bigint, gen_ai_usage_output_tokens bigint, {PROMOTED}, http_request_method string, http_route string, http_response_status_code bigint, url_full string, url_path string, url_query string, {EXCEPTION}, is_exception boolean NOT NULL",
            "start_time",
            "hour",
            ("attributes", "events", "links", "resource_attributes", "resource_entity_refs", "scope_attributes"),
        ),
        _table(
            "metrics",
            "points",
            "metric_name string NOT NULL, description string NOT NULL, unit string NOT NULL, metadata variant NOT NULL, metric_type string NOT NULL, time_unix_nano bigint NOT NULL, time timestamp NOT NULL, start_time_unix_nano bigint NOT NULL, flags bigint NOT NULL, attributes variant NOT NULL, int_value bigint, double_value double, aggregation_temporality int, is_monotonic boolean, histogram_count bigint, histogram_sum double, histogram_min double, histogram_max double, bucket_counts array<bigint>, explicit_bounds array<double>, "
            "exponential_scale int, exponential_zero_count bigint, exponential_zero_threshold double, positive_buckets struct<offset:int,bucket_counts:array<bigint>>, negative_buckets struct<offset:int,bucket_counts:array<bigint>>, summary_count bigint, summary_sum double, quantile_values array<struct<quantile:double,value:double>>, "
            f"exemplars array<struct<time_unix_nano:bigint,int_value:bigint,double_value:double,span_id:binary,trace_id:binary,filtered_attributes:variant>> NOT NULL, {RESOURCE}, {SCOPE}, series_id binary, {PROMOTED}",
            "time",
            "hour",
            ("metadata", "attributes", "exemplars", "resource_attributes", "resource_entity_refs", "scope_attributes"),
        ),
        _table(
            "logs",
            "records",
            f"time_unix_nano bigint NOT NULL, time timestamp NOT NULL, observed_time_unix_nano bigint NOT NULL, severity_number int NOT NULL, severity_text string NOT NULL, event_name string, body variant, trace_id binary, span_id binary, flags bigint NOT NULL, attributes variant NOT NULL, dropped_attributes_count bigint NOT NULL, {RESOURCE}, {SCOPE}, {PROMOTED}, {EXCEPTION}, body_text string, is_exception boolean NOT NULL",
            "time",
            "hour",
            ("body", "attributes", "resource_attributes", "resource_entity_refs", "scope_attributes"),
        ),
        _table("drift", "observations", "record_id string NOT NULL, series string NOT NULL, num_value double, str_value string, session_id string, created_at timestamp NOT NULL", "created_at"),
        _table(
            "gateway",
            "calls",
            "schema_version int NOT NULL, call_id string NOT NULL, request_id_text string NOT NULL, operation string NOT NULL, ingress_dialect string NOT NULL, requested_model struct<deployment:string,model:string> NOT NULL, resolved_model struct<deployment:string,model:string>, resolved_deployment string, streaming boolean NOT NULL, started_at timestamp NOT NULL, terminal_at timestamp NOT NULL, outcome string NOT NULL, error_code string, attempt_count bigint NOT NULL, usage array<struct<dimension:string,unit:string,quantity:string>>, cost string, currency string, pricing_versions array<string> NOT NULL, capture_policy_version bigint NOT NULL, request_payload variant, response_payload variant, payload_object_refs array<struct<digest:string,content_type:string,size_bytes:bigint>> NOT NULL",
            "started_at",
            "hour",
            sensitive=("request_payload", "response_payload"),
        ),
        _table("storage", "objects", "storage_path string NOT NULL, upload_id string, backend string NOT NULL, sha256 string, size_bytes bigint NOT NULL, content_type string, sse_marker string, origin string NOT NULL, relative_path string, state string NOT NULL, recorded_at timestamp NOT NULL", "recorded_at"),
        _table("system", "audit_log", "trace_id string, operation string NOT NULL, resource string NOT NULL, audit_card_ref string, sub_principal_kind string NOT NULL, permission string NOT NULL, outcome string NOT NULL, detail variant, credential_id string, created_at timestamp NOT NULL", "created_at", sensitive=("detail",)),
        _table("verification", "results", "result_id string NOT NULL, execution_id string NOT NULL, execution_status string NOT NULL, verdict string NOT NULL, verifier_version string NOT NULL, verifier_card_uid string NOT NULL, binding_id string, group_id string, trigger_identity string, window_start timestamp, window_end timestamp, started_at timestamp NOT NULL, ended_at timestamp NOT NULL", "ended_at"),
        _table("verification", "approvals", "approval_id string NOT NULL, execution_id string NOT NULL, verifier_card_uid string NOT NULL, decision string NOT NULL, actor_id string NOT NULL, reason string, decided_at timestamp NOT NULL", "decided_at"),
        _table("verification", "execution_inputs", "execution_id string NOT NULL, verifier_card_uid string NOT NULL, binding_id string, group_id string, origin string NOT NULL, queue_execution boolean NOT NULL, inputs variant NOT NULL, activation variant, recorded_at timestamp NOT NULL", "recorded_at", sensitive=("inputs", "activation")),
        _table("verification", "execution_outputs", "result_id string NOT NULL, execution_id string NOT NULL, ended_at timestamp NOT NULL, output variant NOT NULL", "ended_at", sensitive=("output",)),
        _table(
            "verification",
            "execution_events",
            "event_id string NOT NULL, execution_id string NOT NULL, sequence bigint NOT NULL, event string NOT NULL, status string, verifier_card_uid string NOT NULL, step_id string, item_index bigint, iteration_index bigint, attempt bigint, publication_name string, publication_kind string, size_bytes bigint, file_count bigint, sha256 string, reason string, value variant, occurred_at timestamp NOT NULL",
            "occurred_at",
            sensitive=("value",),
        ),
        _table("verification", "evidence", "evidence_id string NOT NULL, host string NOT NULL, repository_id string NOT NULL, commit string NOT NULL, input string NOT NULL, verifier_card_uid string NOT NULL, sha256 string NOT NULL, evidence variant NOT NULL, recorded_at timestamp NOT NULL", "recorded_at", sensitive=("evidence",)),
    )
}
