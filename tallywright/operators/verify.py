"""Verification operators: assertions over JSON evidence, JSONPath, trace checks, step plans, verdicts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.session import load

PASSED, FAILED, INCONCLUSIVE = "passed", "failed", "inconclusive"
MAX_SPANS = 10_000


class CheckError(ValueError):
    """The check cannot be judged: a wrong type, path or plan."""


# --- JSONPath --------------------------------------------------------------
STEP = re.compile(r"\.\.(?P<deep>[A-Za-z_]\w*|\*)|\.(?P<name>[A-Za-z_][\w-]*|\*)|\[(?P<index>-?\d+|\*)\]|\[(?P<q>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")\]|\[(?P<slice>-?\d*:-?\d*)\]|\[\?\(?(?P<filter>.+?)\)?\](?=[.\[]|$)")
FILTER = re.compile(r"^@(?P<path>(?:\.[\w-]+|\[\d+\]|\['[^']*'\])*)\s*(?:(?P<op>==|!=|>=|<=|>|<)\s*(?P<value>.+))?$")


def parse_path(path: str) -> list[tuple[str, Any]]:
    """Steps of a JSONPath; a bad path is an error."""
    if not path.startswith("$"):
        raise CheckError(f"bad path {path!r}")
    at, steps = 1, []
    while at < len(path):
        m = STEP.match(path, at)
        if m is None:
            raise CheckError(f"bad path {path!r} at {at}")
        kind = m.lastgroup
        value: Any = m[kind]
        if kind == "q":
            kind, value = "name", value[1:-1].replace("\\'", "'").replace('\\"', '"')
        elif kind == "index" and value != "*":
            value = int(value)
        elif kind == "filter":
            f = FILTER.match(value.strip())
            if f is None:
                raise CheckError(f"bad filter {value!r}")
            value = (parse_path("$" + f["path"]), f["op"], _json(f["value"].strip()) if f["op"] else None)
        steps.append((kind, value))
        at = m.end()
    return steps


def _json(text: str) -> Any:
    try:
        return json.loads(text[1:-1].join('""') if text[:1] == "'" else text)
    except ValueError as e:
        raise CheckError(f"bad literal {text!r}") from e


def _children(v: Any) -> list[Any]:
    return list(v.values()) if isinstance(v, dict) else list(v) if isinstance(v, list) else []


def _descend(v: Any) -> Iterator[Any]:
    yield v
    for c in _children(v):
        yield from _descend(c)


def _keeps(v: Any, test: tuple) -> bool:
    path, op, want = test
    got = select(v, path)
    if op is None:
        return bool(got)
    if len(got) != 1:
        return op == "!=" and want is not None
    a = got[0]
    if op in ("==", "!="):
        return (_same(a, want)) == (op == "==")
    if isinstance(a, bool) or isinstance(want, bool) or not (isinstance(a, (int, float)) and isinstance(want, (int, float)) or isinstance(a, str) and isinstance(want, str)):
        return False
    return {">": a > want, "<": a < want, ">=": a >= want, "<=": a <= want}[op]


def select(value: Any, steps: list[tuple[str, Any]]) -> list[Any]:
    """All matches in document order."""
    found = [value]
    for kind, arg in steps:
        out: list[Any] = []
        for v in found:
            if kind == "deep":
                for d in _descend(v):
                    out += _children(d) if arg == "*" else [d[arg]] if isinstance(d, dict) and arg in d else []
            elif arg == "*":
                out += _children(v)
            elif kind == "name":
                out += [v[arg]] if isinstance(v, dict) and arg in v else []
            elif kind == "index":
                out += [v[arg]] if isinstance(v, list) and -len(v) <= arg < len(v) else []
            elif kind == "slice":
                a, b = (int(x) if x else None for x in arg.split(":"))
                out += v[a:b] if isinstance(v, list) else []
            else:
                out += [c for c in _children(v) if _keeps(c, arg)]
        found = out
    return found


def extract(value: Any, path: str) -> Any:
    """No match: None; one: the value; more: a list in document order."""
    got = select(value, parse_path(path))
    return None if not got else got[0] if len(got) == 1 else got


def json_path(column: Column, path: str) -> Column:
    """The same over JSON text, as JSON text.

    Plain member paths stay in the JVM (one match at most, so the variant is
    the value); wildcards, slices and filters need a vectorised UDF.
    """
    steps = parse_path(path)
    plain = _plain(steps)
    if plain is not None:
        return F.to_json(F.try_variant_get(F.try_parse_json(column), plain, "variant"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            got = select(json.loads(t), steps)
            return None if not got else json.dumps(got[0] if len(got) == 1 else got, separators=(",", ":"))

        return texts.map(one)

    return run(column)


# --- assertions ------------------------------------------------------------
def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b


def _number(v: Any, op: str) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise CheckError(f"{op} needs numbers, got {type(v).__name__}")
    return v


def _holds(v: Any, want: Any, op: str) -> bool:
    if isinstance(v, str):
        if not isinstance(want, str):
            raise CheckError(f"{op} on text needs text")
        return want in v
    if isinstance(v, list):
        return any(_same(x, want) for x in v)
    raise CheckError(f"{op} needs text or a list, got {type(v).__name__}")


def _superset(v: Any, want: Any) -> bool:
    if not isinstance(v, list) or not isinstance(want, list):
        raise CheckError("is_superset needs lists")
    return all(any(_same(x, w) for x in v) for w in want)


def _filled(v: Any) -> bool:
    if v is None:
        return False
    if not isinstance(v, (str, list, dict)):
        raise CheckError(f"is_non_empty needs text, a list or an object, got {type(v).__name__}")
    return len(v) > 0


def _one_of(v: Any, want: Any) -> bool:
    if not isinstance(want, list):
        raise CheckError("in needs a list")
    return any(_same(v, w) for w in want)


OPERATORS: dict[str, Callable[[Any, Any], bool]] = {
    "equals": _same,
    "not_equals": lambda a, b: not _same(a, b),
    "greater_than": lambda a, b: _number(a, "greater_than") > _number(b, "greater_than"),
    "greater_than_or_equals": lambda a, b: _number(a, "greater_than_or_equals") >= _number(b, "greater_than_or_equals"),
    "contains": lambda a, b: _holds(a, b, "contains"),
    "not_contains": lambda a, b: not _holds(a, b, "not_contains"),
    "in": _one_of,
    "is_not_null": lambda a, b: a is not None,
    "is_non_empty": lambda a, b: _filled(a),
    "is_superset": _superset,
}


@dataclass(frozen=True)
class Outcome:
    verdict: str
    message: str = ""


def assert_value(observed: Any, op: str, expected: Any = None) -> Outcome:
    """One comparison; a type mismatch raises."""
    if op not in OPERATORS:
        raise CheckError(f"unknown operator {op!r}")
    return Outcome(PASSED) if OPERATORS[op](observed, expected) else Outcome(FAILED, f"operator {op} failed")


def assert_each(items: Any, op: str, expected: Any = None) -> Outcome:
    """All items must pass; no items are inconclusive; anything but a list raises."""
    if not isinstance(items, list):
        raise CheckError("item mode needs a list")
    if not items:
        return Outcome(INCONCLUSIVE, "no items")
    bad = sum(assert_value(x, op, expected).verdict == FAILED for x in items)
    return Outcome(FAILED, f"{bad}/{len(items)} items failed operator {op}") if bad else Outcome(PASSED)


def canonical(text: str) -> str:
    """JSON without white space, keys in the order in which they stand."""
    return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))


def canonical_json(column: Column) -> Column:
    """The same in the JVM; NULL for what is no JSON."""
    return F.get_json_object(column, "$")


def capture(text: str, mode: str) -> str | None:
    """Evidence kept in full, as a digest of its canonical form, or not at all."""
    if mode == "full":
        return text
    if mode == "hash":
        return hashlib.sha256(canonical(text).encode()).hexdigest()
    if mode == "redact":
        return None
    raise CheckError(f"unknown capture mode {mode!r}")


NOT_JSON = "the evidence is no JSON"
COMPARE: dict[str, Callable[[Column, Any], Column]] = {"greater_than": lambda c, v: c > v, "greater_than_or_equals": lambda c, v: c >= v}


def assert_column(df: DataFrame, evidence: str, path: str, op: str, expected: Any = None, each: bool = False) -> DataFrame:
    """verdict and message for every row of JSON evidence; errors become verdict ``error``.

    Plain member paths with a numeric comparison or ``is_not_null`` stay in the
    JVM; everything else is judged in Arrow batches.
    """
    steps = parse_path(path)
    if op not in OPERATORS:
        raise CheckError(f"unknown operator {op!r}")
    plain = _plain(steps)
    number = isinstance(expected, (int, float)) and not isinstance(expected, bool)
    if plain is not None and not each and (op in COMPARE and number or op == "is_not_null"):
        return df.select("*", *_judged(F.col(evidence), plain, op, expected))

    @F.pandas_udf("verdict string, message string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                got = select(_parsed(t), steps) if t is not None else []
                value = None if not got else got[0] if len(got) == 1 else got
                o = assert_each(value, op, expected) if each else assert_value(value, op, expected)
                rows.append((o.verdict, o.message))
            except CheckError as e:
                rows.append(("error", str(e)))
        return pd.DataFrame(rows, columns=["verdict", "message"])

    return df.withColumn("_o", judge(F.col(evidence))).select("*", "_o.verdict", "_o.message").drop("_o")


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError as e:
        raise CheckError(NOT_JSON) from e


def _plain(steps: list[tuple[str, Any]]) -> str | None:
    """The path as a variant path if it is made of names and indexes alone."""
    if all(k == "name" and a != "*" and '"' not in a or k == "index" and isinstance(a, int) and a >= 0 for k, a in steps):
        return "$" + "".join(f"[{a}]" if k == "index" else f'["{a}"]' for k, a in steps)
    return None


def _judged(evidence: Column, path: str, op: str, expected: Any) -> tuple[Column, Column]:
    """verdict and message of one comparison of a plain path, as expressions."""
    whole = F.try_parse_json(evidence)
    found = F.try_variant_get(whole, path, "variant")
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(found), F.lit("VOID")), "^[A-Z]+", 0)
    broken = evidence.isNotNull() & whole.isNull()
    if op == "is_not_null":
        wrong, holds = F.lit(False), kind != "VOID"
    else:
        wrong = ~kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
        exact = COMPARE[op](F.try_variant_get(whole, path, "decimal(38,0)"), F.lit(expected).cast("decimal(38,0)")) if isinstance(expected, int) and abs(expected) < 10**37 else F.lit(None).cast("boolean")
        holds = F.when(kind == "BIGINT", F.coalesce(exact, COMPARE[op](F.try_variant_get(whole, path, "double"), float(expected)))).otherwise(COMPARE[op](F.try_variant_get(whole, path, "double"), float(expected)))
    names = {"BOOLEAN": "bool", "STRING": "str", "OBJECT": "dict", "ARRAY": "list", "VOID": "NoneType"}
    named = F.coalesce(*(F.when(kind == k, v) for k, v in names.items()), F.lower(kind))
    verdict = F.when(broken | wrong, "error").when(holds, PASSED).otherwise(FAILED)
    message = F.when(broken, NOT_JSON).when(wrong, F.concat(F.lit(f"{op} needs numbers, got "), named)).when(holds, "").otherwise(f"operator {op} failed")
    return verdict.alias("verdict"), message.alias("message")


# --- traces ----------------------------------------------------------------
def trace_document(spans: DataFrame, trace_id: Column | None = None) -> DataFrame:
    """One row for each trace: its spans in order of start and span id as JSON; more than MAX_SPANS raise."""
    src = spans if trace_id is None else spans.where(F.col("trace_id") == trace_id)
    # counted first: a trace that is too long never becomes a list
    size = src.groupBy("trace_id").agg(F.count("*").alias("n"))
    size = size.withColumn("n", F.when(F.col("n") > MAX_SPANS, F.raise_error(F.lit(f"more than {MAX_SPANS} spans"))).otherwise(F.col("n")))
    one = F.struct("start", "span_id", "name", "attributes")
    g = src.join(size, "trace_id").groupBy("trace_id", "n").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return g.select("trace_id", "n", F.to_json(F.struct("spans")).alias("document"))


def timeline(spans: DataFrame, seed) -> DataFrame:
    """The seed trace and every trace that links directly to it, each span once, in total order."""
    linked = spans.where(F.exists("links", lambda e: e.trace_id == F.lit(seed))).select("trace_id").distinct()
    own = spans.where(F.col("trace_id") == F.lit(seed))
    return own.unionByName(spans.join(linked, "trace_id", "left_semi")).dropDuplicates(["trace_id", "span_id"]).orderBy("start", "trace_id", "span_id")


# --- step plans ------------------------------------------------------------
def plan_stages(steps: dict[str, list[str]]) -> list[list[str]]:
    """Layers of steps whose dependencies are in earlier layers, ids sorted; names a missing step or the smallest cycle."""
    for s, needs in sorted(steps.items()):
        for d in sorted(needs):
            if d == s:
                raise CheckError(f"step {s!r} depends on itself")
            if d not in steps:
                raise CheckError(f"step {s!r} depends on missing step {d!r}")
    done: set[str] = set()
    out: list[list[str]] = []
    while len(done) < len(steps):
        layer = sorted(s for s in steps if s not in done and all(d in done for d in steps[s]))
        if not layer:
            raise CheckError("cycle: " + " -> ".join(_cycle({s: d for s, d in steps.items() if s not in done})))
        out.append(layer)
        done.update(layer)
    return out


def _cycle(steps: dict[str, list[str]]) -> list[str]:
    best: list[str] = []
    for start in sorted(steps):
        queue, seen = [[start]], {start}
        while queue:
            path = queue.pop(0)
            if best and len(path) >= len(best):
                break
            for d in sorted(steps[path[-1]]):
                if d == start:
                    best = [*path, start] if not best or len(path) + 1 < len(best) else best
                elif d in steps and d not in seen:
                    seen.add(d)
                    queue.append([*path, d])
    return best


def for_each(df: DataFrame, items: str, max_items: int) -> DataFrame:
    """One row for each item with its index; a longer list raises."""
    size = F.size(items)
    checked = F.when(size > max_items, F.raise_error(F.lit(f"more than {max_items} items"))).otherwise(F.col(items))
    return df.select("*", F.posexplode(checked).alias("index", "item"))


def repeat_until(start: Any, step: Callable[[Any], Any], until: Callable[[Any], bool], max_iterations: int) -> tuple[Any, int, bool]:
    """Run a step until its result satisfies ``until``; the result, the runs and whether it did."""
    value = start
    for k in range(1, max_iterations + 1):
        value = step(value)
        if until(value):
            return value, k, True
    return value, max_iterations, False


@dataclass
class Ledger:
    """Results in the order in which steps settled; recording again replaces in place."""

    entries: dict[str, Any] = field(default_factory=dict)

    def record(self, step: str, result: Any) -> None:
        self.entries[step] = result


def decide(requirements: DataFrame, results: DataFrame) -> DataFrame:
    """Verdict of each subject over its declared requirements.

    ``requirements``: subject, requirement, and optionally needs, the
    requirement that this one depends on.  ``results``: subject, requirement,
    verdict (or skipped).  A missing result is inconclusive and stays in the
    denominator of the pass rate; so is one whose dependency did not pass,
    whatever its own result; all skipped is inconclusive too.
    """
    j = requirements.join(results, ["subject", "requirement"], "left")
    if "needs" in requirements.columns:
        before = results.select("subject", F.col("requirement").alias("needs"), F.col("verdict").alias("_before"))
        j = j.join(before, ["subject", "needs"], "left")
        met = F.col("needs").isNull() | (F.col("_before") == PASSED)
        j = j.withColumn("verdict", F.when(F.coalesce(met, F.lit(False)), F.col("verdict")))
    n, passed = F.count("*"), F.count_if(F.col("verdict") == PASSED)
    failed, skipped = F.count_if(F.col("verdict") == FAILED), F.count_if(F.col("verdict") == "skipped")
    verdict = F.when(failed > 0, FAILED).when((passed + skipped == n) & (passed > 0), PASSED).otherwise(INCONCLUSIVE)
    return j.groupBy("subject").agg(verdict.alias("verdict"), (passed / n).alias("pass_rate"), n.alias("declared"))


def schema_has_path(schema: dict, path: str) -> bool:
    """Whether a JSON Schema can hold the path; what the schema leaves open counts as possible."""
    here = [schema]
    for kind, arg in parse_path(path):
        nxt: list[dict] = []
        for s in here:
            for alt in [s, *s.get("anyOf", []), *s.get("oneOf", []), *s.get("allOf", [])]:
                props, extra = alt.get("properties"), alt.get("additionalProperties", True)
                if kind == "name" and arg != "*":
                    if props and arg in props:
                        nxt.append(props[arg])
                    elif alt.get("type", "object") == "object" and extra:
                        nxt.append(extra if isinstance(extra, dict) else {})
                elif kind == "deep":
                    nxt.append({})
                elif alt.get("type", "array") == "array":
                    nxt.append(alt.get("items", {}) if isinstance(alt.get("items", {}), dict) else {})
                elif arg == "*" and props:
                    nxt += props.values()
        here = nxt
        if not here:
            return False
    return True


# --- queries ---------------------------------------------------------------
def assert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's ``$.k`` greater than 50."""
    return assert_column(load(spark, sf_dir, "events").select("event_id", "props"), "props", "$.k", "greater_than", 50).select("event_id", "verdict")


def evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json(F.col("props")), 256).alias("digest"))


#: One use of each operator: path, expected value.
CASES: dict[str, tuple[str, Any]] = {
    "equals": ("$.type", "click"),
    "not_equals": ("$.k", 42),
    "greater_than": ("$.k", 50),
    "greater_than_or_equals": ("$.k", 50),
    "contains": ("$.type", "ic"),
    "not_contains": ("$.tags", "error"),
    "in": ("$.type", ["click", "error"]),
    "is_not_null": ("$.odd", None),
    "is_non_empty": ("$.tags", None),
    "is_superset": ("$.tags", ["click", "all"]),
}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 2 == 1, F.col("event_id"))
    body = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("type"), F.array("event_type", F.lit("all")).alias("tags"), odd.alias("odd"), F.array(F.col("user_id"), F.col("event_id")).alias("ids"))
    return ev.select("event_id", F.to_json(body).alias("evidence"))


def assert_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every comparison operator over all events."""
    src, out = _evidence(spark, sf_dir), None
    for op, (path, expected) in CASES.items():
        here = assert_column(src, "evidence", path, op, expected).groupBy("verdict").agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "verdict", "n")
        out = here if out is None else out.unionByName(here)
    return out


def assert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item mode: every id of a list at least 20."""
    return assert_column(_evidence(spark, sf_dir), "evidence", "$.ids", "greater_than_or_equals", 20, each=True).select("event_id", "verdict", "message")


def step_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a plan whose steps are regions and nations: a nation needs its region, and the nation before it there."""
    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_regionkey", "n_nationkey").collect()
    steps: dict[str, list[str]] = {}
    last: dict[int, str] = {}
    for r in rows:
        steps.setdefault(f"r{r['n_regionkey']}", [])
        name = f"n{r['n_nationkey']}"
        steps[name] = [f"r{r['n_regionkey']}", *([last[r["n_regionkey"]]] if r["n_regionkey"] in last else [])]
        last[r["n_regionkey"]] = name
    return spark.createDataFrame([(s, k) for k, layer in enumerate(plan_stages(steps)) for s in layer], "step string, stage int")


def for_each_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each event's type list with their indexes."""
    ev = load(spark, sf_dir, "events").select("event_id", F.array("event_type", F.lit("all")).alias("tags"))
    return for_each(ev, "tags", 2).select("event_id", "index", "item")


def dependent_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases count for a user only if the clicks passed."""
    ev = load(spark, sf_dir, "events")
    kinds = spark.createDataFrame([("click", None), ("purchase", "click")], "requirement string, needs string")
    req = ev.select(F.col("user_id").alias("subject")).distinct().crossJoin(F.broadcast(kinds))
    res = ev.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("requirement")).agg(F.when(F.avg("value") > 45, PASSED).otherwise(FAILED).alias("verdict"))
    return decide(req, res).select("subject", "verdict", F.round("pass_rate", 9).alias("pass_rate"), "declared")


def trace_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a trace: names of the spans in order."""
    ev = load(spark, sf_dir, "events")
    spans = ev.select(F.col("user_id").alias("trace_id"), F.col("ts").alias("start"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), F.col("props").alias("attributes"))
    doc = trace_document(spans)
    return doc.select("trace_id", "n", json_path(F.col("document"), "$.spans[*].name").alias("names"))


def verdict_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements: every event type for every user; results: whether the mean value is above 45."""
    ev = load(spark, sf_dir, "events")
    req = ev.select(F.col("user_id").alias("subject")).distinct().crossJoin(F.broadcast(ev.select(F.col("event_type").alias("requirement")).distinct()))
    res = ev.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("requirement")).agg(F.when(F.avg("value") > 10, PASSED).otherwise(FAILED).alias("verdict"))
    return decide(req, res).select("subject", "verdict", F.round("pass_rate", 9).alias("pass_rate"), "declared")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (assert_rules, assert_operators, assert_items, evidence_digest, trace_select, step_stages, for_each_item, verdict_roll_up, dependent_verdicts)}
ORACLE_SQL: dict[str, str] = {
    "assert_rules": "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'passed' ELSE 'failed' END AS verdict FROM events",
    "assert_operators": """WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (
        SELECT 'equals' AS op, event_type = 'click' AS ok FROM e UNION ALL SELECT 'not_equals', coalesce(k <> 42, true) FROM e
        UNION ALL SELECT 'greater_than', k > 50 FROM e UNION ALL SELECT 'greater_than_or_equals', k >= 50 FROM e
        UNION ALL SELECT 'contains', event_type LIKE '%ic%' FROM e UNION ALL SELECT 'not_contains', event_type <> 'error' FROM e
        UNION ALL SELECT 'in', event_type IN ('click', 'error') FROM e UNION ALL SELECT 'is_not_null', event_id % 2 = 1 FROM e
        UNION ALL SELECT 'is_non_empty', true FROM e UNION ALL SELECT 'is_superset', event_type = 'click' FROM e)
        SELECT op, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS verdict, count(*) AS n FROM r GROUP BY 1, 2""",
    "assert_items": "WITH e AS (SELECT event_id, (user_id < 20)::INT + (event_id < 20)::INT AS bad FROM events) SELECT event_id, CASE WHEN bad > 0 THEN 'failed' ELSE 'passed' END AS verdict, CASE WHEN bad > 0 THEN bad || '/2 items failed operator greater_than_or_equals' ELSE '' END AS message FROM e",
    "evidence_digest": "SELECT event_id, sha256(json(props)::VARCHAR) AS digest FROM events",
    "step_stages": "SELECT DISTINCT 'r' || n_regionkey AS step, 0 AS stage FROM nation UNION ALL SELECT 'n' || n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) FROM nation",
    "for_each_item": "SELECT event_id, 0 AS index, event_type AS item FROM events UNION ALL SELECT event_id, 1, 'all' FROM events",
    "dependent_verdicts": "WITH u AS (SELECT DISTINCT user_id FROM events), v AS (SELECT user_id, event_type, avg(value) > 45 AS ok FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2), j AS (SELECT u.user_id, c.ok AS c, CASE WHEN c.ok THEN p.ok END AS p FROM u LEFT JOIN v c ON c.user_id = u.user_id AND c.event_type = 'click' LEFT JOIN v p ON p.user_id = u.user_id AND p.event_type = 'purchase') SELECT user_id AS subject, CASE WHEN NOT coalesce(c, true) OR NOT coalesce(p, true) THEN 'failed' WHEN c AND p THEN 'passed' ELSE 'inconclusive' END AS verdict, round((coalesce(c, false)::INT + coalesce(p, false)::INT) / 2, 9) AS pass_rate, CAST(2 AS BIGINT) AS declared FROM j",
    "trace_select": """SELECT user_id AS trace_id, count(*) AS n, CASE WHEN count(*) = 1 THEN '"' || any_value(event_type) || '"' ELSE '[' || string_agg('"' || event_type || '"', ',' ORDER BY ts, event_id) || ']' END AS names FROM events GROUP BY user_id""",
    "verdict_roll_up": "WITH r AS (SELECT u.user_id AS subject, t.event_type AS requirement FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t), v AS (SELECT user_id AS subject, event_type AS requirement, CASE WHEN avg(value) > 10 THEN 'passed' ELSE 'failed' END AS verdict FROM events GROUP BY 1, 2) SELECT subject, CASE WHEN count(*) FILTER (WHERE verdict = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE verdict = 'passed') = count(*) THEN 'passed' ELSE 'inconclusive' END AS verdict, round(count(*) FILTER (WHERE verdict = 'passed') / count(*), 9) AS pass_rate, count(*) AS declared FROM r LEFT JOIN v USING (subject, requirement) GROUP BY subject",
}
