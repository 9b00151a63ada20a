"""What a statement must satisfy before it runs, and how its result ends."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.plans import dialect

STATEMENT_BYTES = 64 << 10
PREDICATE_BYTES = 8 << 10
#: Plan nodes of a query; a statement with any other node is refused.
QUERY_NODES = set(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith Union Intersect Except Distinct "
    "UnresolvedInlineTable LocalRelation OneRowRelation Generate UnresolvedSubqueryColumnAliases WithWindowDefinition Pivot Unpivot Sample UnresolvedTableValuedFunction".split()
)
#: Table functions that only use their arguments, and scalar ones that reach outside the query.
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "range", "variant_explode", "variant_explode_outer"}
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}


class Refused(ValueError):
    """The request is refused before any data is read."""


@dataclass(frozen=True)
class Statement:
    sql: str
    tables: tuple[str, ...]


def check_statement(sql: str, spark: SparkSession | None = None) -> Statement:
    """One query within the byte limit; returns it with every table that its parsed plan reads.

    Spark's own parser reads the statement once, for this check and for its
    tables: whatever is no query, and any relation but a named table (or a
    common table expression in scope), is refused.
    """
    if not sql.strip():
        raise Refused("the statement is empty")
    if len(sql.encode()) > STATEMENT_BYTES:
        raise Refused(f"the statement is longer than {STATEMENT_BYTES} bytes")
    toks = dialect.tokens(sql)
    while toks and toks[-1][1] == ";":
        toks.pop()
    if any(t == ("op", ";") for t in toks):
        raise Refused("exactly one statement is allowed")
    for (kind, x), after in zip(toks, [*toks[1:], ("", "")]):
        if kind in ("name", "quoted") and after[1] == "(" and x.strip('"`').lower() in FORBIDDEN_FUNCTIONS:
            raise Refused(f"{x} is not allowed")
    spark = spark or SparkSession.active()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect.rewrite(sql).rstrip("; \n"))
    except Exception as e:
        raise Refused(str(e).strip().splitlines()[0]) from e
    return Statement(sql, tuple(dict.fromkeys(_relations(plan, frozenset()))))


def _relations(plan, ctes: frozenset[str]) -> Iterator[str]:
    """Full names of the tables that a parsed plan reads, subqueries included; refuses what is no query."""
    kind = plan.getClass().getSimpleName()
    if kind not in QUERY_NODES:
        raise Refused("only SELECT is allowed")
    if kind == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in ctes:
            yield ".".join(parts)
    elif kind == "UnresolvedTableValuedFunction" and [x.lower() for x in _seq(plan.name())][-1] not in TABLE_FUNCTIONS:
        raise Refused("no such table function")
    elif kind == "UnresolvedWith":
        for t in _seq(plan.cteRelations()):
            own = {t._1().lower()} if plan.allowRecursion() else set()
            yield from _relations(t._2(), ctes | own)
            ctes = ctes | {t._1().lower()}
    for part in (*_seq(plan.children()), *_seq(plan.subqueries())):
        yield from _relations(part, ctes)


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.length())]


def check_predicate(spark: SparkSession, schema: T.StructType, text: str) -> str:
    """A stand-alone predicate over one table's columns, in normal form; blank stays blank."""
    if not text.strip():
        return ""
    if len(text.encode()) > PREDICATE_BYTES:
        raise Refused(f"the predicate is longer than {PREDICATE_BYTES} bytes")
    if "--" in _outside_strings(text) or "/*" in _outside_strings(text):
        raise Refused("comments are not allowed")
    toks = dialect.tokens(text)
    for kind, x in toks:
        if x == ";" or kind == "bind" or kind == "name" and x.lower() in ("select", "from", "exists", "with"):
            raise Refused(f"{x!r} is not allowed in a predicate")
    plain = dialect.rewrite(text)
    empty = spark.createDataFrame([], schema)
    try:
        typed = empty.select(F.expr(plain).alias("p"))
    except Exception as e:
        raise Refused(str(e).splitlines()[0]) from e
    if typed.schema["p"].dataType != T.BooleanType():
        raise Refused("the predicate is not boolean")
    check_types(empty, plain)
    return dialect._text(toks)


def _outside_strings(text: str) -> str:
    return dialect.re.sub(r"'(?:[^']|'')*'", "''", text)


def check_types(df: DataFrame, expression: str) -> None:
    """Refuse arithmetic between text and numbers, which Spark would coerce."""
    jvm_plan = df.select(F.expr(expression).alias("p"))._jdf.queryExecution().analyzed().toString()
    if dialect.re.search(r"[-+*/%] cast\(\w+#\d+L? as (bigint|int|double|decimal\([\d,]+\))\)|cast\(\w+#\d+L? as (bigint|double)\) [-+*/%]", jvm_plan):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for m in dialect.re.finditer(r"cast\((\w+)#\d+L? as (?:bigint|int|double|decimal\([\d,]+\))\)", jvm_plan):
            if isinstance(kinds.get(m[1]), T.StringType):
                raise Refused(f"text column {m[1]!r} in arithmetic")


@dataclass(frozen=True)
class Caller:
    """Who asks: readable tables (None: all), and whether sensitive columns may be read."""

    tenant: str
    tables: frozenset[str] | None = None
    sensitive: bool = False


def authorize(caller: Caller, statement: Statement, known: Mapping[str, object]) -> None:
    """Tables first, and without naming columns, before any data IO."""
    for t in statement.tables:
        if t not in known or caller.tables is not None and t not in caller.tables:
            raise PermissionError("table not found or not allowed")


def visible(df: DataFrame, sensitive: tuple[str, ...], caller: Caller) -> DataFrame:
    """The table without its sensitive columns for a caller who may not read them."""
    return df if caller.sensitive else df.drop(*sensitive)


@dataclass
class Terminal:
    """How a result ended."""

    outcome: str = "success"
    klass: str = "interactive"
    rows: int = 0
    warnings: list[str] = field(default_factory=list)


def collect_bounded(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 16 << 20) -> pa.Table:
    """The whole result, or a refusal if it is larger; never a part of it."""
    got = df.limit(max_rows + 1).toArrow()
    if got.num_rows > max_rows:
        raise Refused(f"the result has more than {max_rows} rows")
    if got.nbytes > max_bytes:
        raise Refused(f"the result is larger than {max_bytes} bytes")
    return got


def clamp_deadline(asked: float | None, default: float = 7200.0, most: float = 7200.0) -> float:
    return default if asked is None or asked <= 0 else min(asked, most)


class Running:
    """Queries that run now, each with a tag to cancel it by and a timer for its deadline."""

    def __init__(self, spark: SparkSession):
        self.spark, self.active = spark, {}

    def collect(self, df: DataFrame, deadline: float | None = None, **limits) -> tuple[pa.Table | None, Terminal]:
        tag = f"q{uuid.uuid4().hex}"
        timer = threading.Timer(clamp_deadline(deadline), self.cancel, [tag])
        self.active[tag] = time.time()
        self.spark.addTag(tag)
        timer.daemon = True
        timer.start()
        try:
            got = collect_bounded(df, **limits)
            exchange = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
            return got, Terminal("success", "analytical" if exchange else "interactive", got.num_rows)
        except (Refused, AnalysisException):
            raise
        except Exception as e:
            return None, Terminal("failed", warnings=[str(e).splitlines()[0]])
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
            self.active.pop(tag, None)

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)
