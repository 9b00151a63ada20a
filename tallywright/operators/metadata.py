"""The metadata query language: text to a syntax tree, back to canonical text, and to a Spark predicate.

Grammar: ``or`` over ``and`` over ``not`` over groups and predicates;
predicates compare a field (``labels.env``, ``annotations."a.b"``, or a
reserved name) with a literal.  Negation includes absence: ``!=`` and
``not in`` also match rows where the field is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.session import load

MAX_PREDICATES, MAX_DEPTH = 64, 8
MAPS = ("labels", "annotations", "attributes")
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<dur>-?\d+(?:ns|us|ms|s|m|h)\b)|(?P<float>-?\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>-?\d+)|(?P<op>=~|!~|!=|>=|<=|=|>|<|[()\[\],.])|(?P<word>[A-Za-z_][A-Za-z0-9_-]*))')


class QueryError(ValueError):
    """The query cannot be read or is beyond its bounds."""


@dataclass(frozen=True)
class Duration:
    ns: int


@dataclass(frozen=True)
class Field:
    scope: str | None
    key: str


@dataclass(frozen=True)
class Predicate:
    field: Field
    op: str
    value: object = None


@dataclass(frozen=True)
class Group:
    op: str
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEX.match(text, at)
        if m is None:
            raise QueryError(f"unreadable text at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks, self.at = _lex(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or want is not None and t[1] != want:
            raise QueryError(f"expected {want or 'more'}, got {t[1] or 'the end'!r}")
        self.at += 1
        return t

    def either(self, word: str, below: Callable):
        items = [below()]
        while self.peek() == ("word", word):
            self.take()
            items.append(below())
        if len(items) == 1:
            return items[0]
        flat = [y for x in items for y in (x.items if isinstance(x, Group) and x.op == word else (x,))]
        return Group(word, tuple(flat))

    def any(self):
        return self.either("or", self.all)

    def all(self):
        return self.either("and", self.unary)

    def unary(self):
        if self.peek() == ("word", "not"):
            self.take()
            return Not(self.unary())
        if self.peek()[1] == "(":
            self.take()
            if self.peek()[1] == ")":
                raise QueryError("empty group")
            inner = self.any()
            self.take(")")
            return inner
        return self.predicate()

    def field(self) -> Field:
        kind, name = self.take()
        if kind != "word":
            raise QueryError(f"expected a field, got {name!r}")
        if name not in MAPS:
            return Field(None, name)
        self.take(".")
        keys = []
        while True:
            kind, key = self.take()
            if kind not in ("word", "str"):
                raise QueryError(f"expected a key, got {key!r}")
            keys.append(_text(key) if kind == "str" else key)
            if self.peek()[1] != ".":
                return Field(name, ".".join(keys))
            self.take()

    def predicate(self) -> Predicate:
        f = self.field()
        kind, x = self.take()
        if kind == "word" and x == "exists":
            return Predicate(f, "exists")
        if kind == "word" and x == "not":
            _, y = self.take()
            if y == "exists":
                return Predicate(f, "not exists")
            if y == "in":
                return Predicate(f, "not in", self.values())
            raise QueryError(f"unknown operator 'not {y}'")
        if kind == "word" and x == "in":
            return Predicate(f, "in", self.values())
        if kind != "op" or x in "()[],.":
            raise QueryError(f"unknown operator {x!r}")
        value = self.literal()
        if x in ("=~", "!~") and not isinstance(value, str):
            raise QueryError("a pattern must be text")
        return Predicate(f, x, value)

    def values(self) -> tuple:
        self.take("[")
        out = [self.literal()]
        while self.peek()[1] == ",":
            self.take()
            out.append(self.literal())
        self.take("]")
        return tuple(out)

    def literal(self):
        kind, x = self.take()
        if kind == "str":
            return _text(x)
        if kind == "int":
            return int(x)
        if kind == "float":
            return float(x)
        if kind == "dur":
            n, u = re.match(r"(-?\d+)(\w+)", x).groups()
            return Duration(int(n) * UNITS[u])
        if kind == "word" and x in ("true", "false"):
            return x == "true"
        raise QueryError(f"expected a literal, got {x!r}")


def _text(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


def parse(text: str):
    """The syntax tree of a query, checked against the bounds."""
    p = _Parser(text)
    if not p.toks:
        raise QueryError("empty query")
    tree = p.any()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r}")
    validate(tree)
    return tree


def validate(tree) -> None:
    def walk(x, depth: int) -> int:
        if depth > MAX_DEPTH:
            raise QueryError(f"deeper than {MAX_DEPTH}")
        if isinstance(x, Predicate):
            return 1
        items = (x.item,) if isinstance(x, Not) else x.items
        if not items:
            raise QueryError("empty group")
        return sum(walk(i, depth + 1) for i in items)

    if walk(tree, 0) > MAX_PREDICATES:
        raise QueryError(f"more than {MAX_PREDICATES} predicates")


def _literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(v, Duration):
        unit = next((u for u in ("h", "m", "s", "ms", "us") if v.ns % UNITS[u] == 0 and v.ns), "ns")
        return f"{v.ns // UNITS[unit]}{unit}"
    return repr(v)


def show(tree) -> str:
    """Canonical text; parsing it gives the tree back."""
    if isinstance(tree, Predicate):
        f = tree.field
        name = f.key if f.scope is None else f"{f.scope}.{f.key if re.fullmatch(r'[A-Za-z_][A-Za-z0-9_-]*', f.key) else _literal(f.key)}"
        if tree.op in ("exists", "not exists"):
            return f"{name} {tree.op}"
        value = "[" + ", ".join(map(_literal, tree.value)) + "]" if tree.op in ("in", "not in") else _literal(tree.value)
        return f"{name} {tree.op} {value}"
    if isinstance(tree, Not):
        return f"not {f'({show(tree.item)})' if isinstance(tree.item, Group) else show(tree.item)}"
    return f" {tree.op} ".join(f"({show(i)})" if isinstance(i, Group) else show(i) for i in tree.items)


Resolver = Callable[[Field], Column]


def resolver(reserved: dict[str, str], maps: dict[str, str]) -> Resolver:
    """Fields of one surface: reserved names and maps by column."""

    def resolve(f: Field) -> Column:
        if f.scope is None:
            if f.key not in reserved:
                raise QueryError(f"unknown field {f.key!r}")
            return F.col(reserved[f.key])
        if f.scope not in maps:
            raise QueryError(f"{f.scope} cannot be searched here")
        return F.try_element_at(F.col(maps[f.scope]), F.lit(f.key))

    return resolve


CARDS = resolver({k: k for k in ("created_at", "updated_at", "status", "name", "kind")}, {"labels": "labels", "annotations": "annotations"})


def _value(v):
    return F.lit(v.ns if isinstance(v, Duration) else v)


def compile_query(tree, resolve: Resolver) -> Column:
    """The Spark predicate: never NULL, so ``not`` is a complement."""
    if isinstance(tree, Not):
        return ~compile_query(tree.item, resolve)
    if isinstance(tree, Group):
        parts = [compile_query(i, resolve) for i in tree.items]
        return reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)
    c, op, v = resolve(tree.field), tree.op, tree.value
    if op == "exists":
        return c.isNotNull()
    if op == "not exists":
        return c.isNull()
    if op in ("in", "not in"):
        hit = F.coalesce(c.isin([x.ns if isinstance(x, Duration) else x for x in v]), F.lit(False))
        return hit if op == "in" else ~hit
    if op in ("=~", "!~"):
        hit = F.coalesce(c.rlike(v), F.lit(False))
        return hit if op == "=~" else ~hit
    if op in ("=", "!="):
        hit = F.coalesce(c == _value(v), F.lit(False))
        return hit if op == "=" else ~hit
    cmp = {">": c > _value(v), ">=": c >= _value(v), "<": c < _value(v), "<=": c <= _value(v)}[op]
    return F.coalesce(cmp, F.lit(False))


def search(df: DataFrame, text: str, resolve: Resolver) -> DataFrame:
    return df.where(compile_query(parse(text), resolve))


def keyset_page(df: DataFrame, keys: tuple[str, ...], after: tuple | None, limit: int) -> tuple[DataFrame, Callable[[], tuple | None]]:
    """A page of at most ``limit`` (1 to 200) rows after the key, and a function that gives the next key if there is more."""
    if not 1 <= limit <= 200:
        raise QueryError("the limit must be from 1 to 200")
    src = df
    if after is not None:
        # the first key alone reaches the files; the whole key decides
        src = df.where(F.col(keys[0]) >= F.lit(after[0]).cast(df.schema[keys[0]].dataType))
    src = src if after is None else src.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after)]))
    probe = src.orderBy(*keys).limit(limit + 1)

    def following() -> tuple | None:
        got = probe.select(*keys).collect()
        return tuple(got[limit - 1]) if len(got) > limit else None

    return probe.limit(limit), following


def latest_version(df: DataFrame, least: tuple[int, int, int], below: tuple[int, int, int] | None = None) -> DataFrame:
    """The newest stable (major, minor, patch) in [least, below)."""
    v = F.struct("major", "minor", "patch")

    def bound(t):
        return F.struct(*[F.lit(x).cast(df.schema[n].dataType).alias(n) for n, x in zip(("major", "minor", "patch"), t)])

    cond = (v >= bound(least)) & F.col("pre").isNull()
    if below is not None:
        cond &= v < bound(below)
    return df.where(cond).orderBy(v.desc()).limit(1)


def list_cards(df: DataFrame, kind: str | None = None, name: str | None = None, status: str | None = None, least: tuple[int, int, int] | None = None, below: tuple[int, int, int] | None = None, prerelease: bool = False) -> DataFrame:
    """Cards by kind, name, status and version range; deleted ones only if asked for, pre-releases only with ``prerelease``."""
    v = F.struct("major", "minor", "patch")

    def bound(t):
        return F.struct(*[F.lit(x).cast(df.schema[n].dataType).alias(n) for n, x in zip(("major", "minor", "patch"), t)])

    out = df.where(F.col("status") != "deleted") if status is None else df.where(F.col("status") == status)
    out = out if kind is None else out.where(F.col("kind") == kind)
    out = out if name is None else out.where(F.col("name") == name)
    out = out if least is None else out.where(v >= bound(least))
    out = out if below is None else out.where(v < bound(below))
    return out if prerelease else out.where(F.col("pre").isNull())


# --- queries ---------------------------------------------------------------
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("env"), F.lit("prod"), F.lit("lang"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("env"), F.lit("dev"))).otherwise(F.create_map().cast("map<string,string>"))
    return d.withColumn("labels", labels).withColumn("status", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))))


DOCS = resolver({"status": "status", "source": "source", "n_chars": "n_chars"}, {"labels": "labels"})


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), 'labels.env != "prod" and not (status = "s1" or n_chars > 5000) or labels.lang in ["fr", "es"]', DOCS).select("doc_id")


#: A query for each operator and kind of literal, with the condition in SQL.
OPERATOR_QUERIES: dict[str, str] = {
    'labels.env = "prod"': "doc_id % 3 = 0",
    'labels.env != "prod"': "doc_id % 3 <> 0",
    "n_chars > 1000": "n_chars > 1000",
    "n_chars >= 1000": "n_chars >= 1000",
    "n_chars < 1000": "n_chars < 1000",
    "n_chars <= 1us": "n_chars <= 1000",
    'status =~ "^s[12]$"': "doc_id % 5 IN (1, 2)",
    'status !~ "^s[12]$"': "doc_id % 5 NOT IN (1, 2)",
    'status in ["s1", "s3"]': "doc_id % 5 IN (1, 3)",
    'status not in ["s1", "s3"]': "doc_id % 5 NOT IN (1, 3)",
    "labels.lang exists": "doc_id % 3 = 0 AND lang IS NOT NULL",
    "labels.lang not exists": "NOT (doc_id % 3 = 0 AND lang IS NOT NULL)",
    'not (labels."env" = "dev" or n_chars > 2ms) and status exists': "NOT (doc_id % 3 = 1 OR n_chars > 2000000) AND doc_id % 5 <> 0",
}


def metadata_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every operator's query, and its canonical text, which reads back as the same query."""
    d, out = _documents(spark, sf_dir), None
    for k, text in enumerate(OPERATOR_QUERIES):
        tree = parse(text)
        if parse(show(tree)) != tree:
            raise QueryError(f"{text!r} does not read back")
        here = search(d, show(tree), DOCS).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
        out = here if out is None else out.unionByName(here)
    return out


def card_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "model").otherwise("prompt").alias("kind"), F.concat(F.lit("n"), (F.col("p_partkey") % 10).cast("string")).alias("name"), F.when(F.col("p_partkey") % 9 == 0, "deleted").otherwise("active").alias("status"), (F.col("p_partkey") % 4).alias("major"), (F.col("p_partkey") % 7).alias("minor"), F.col("p_partkey").alias("patch"), F.when(F.col("p_partkey") % 5 == 0, "rc").alias("pre"))
    return list_cards(p, kind="model", name="n4", least=(1, 2, 0), below=(3, 0, 0)).select("id").unionByName(list_cards(p, status="deleted", prerelease=True).select("id"))


def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = keyset_page(load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ("o_orderdate", "o_orderkey"), ("2023-06-01 00:00:00", 0), 50)
    return page.select("o_orderkey")


def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("major"), (F.col("p_partkey") % 7).alias("minor"), F.col("p_partkey").alias("patch"), F.when(F.col("p_partkey") % 5 == 0, "rc").alias("pre"))
    return latest_version(p, (1, 2, 0), (3, 0, 0)).select("major", "minor", "patch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (metadata_filter, metadata_operators, card_list, keyset_pages, version_latest)}
ORACLE_SQL: dict[str, str] = {
    "metadata_filter": "SELECT doc_id FROM documents WHERE (doc_id % 3 <> 0 AND NOT ((doc_id % 5 = 1) OR n_chars > 5000)) OR (doc_id % 3 = 0 AND lang IN ('fr', 'es'))",
    "metadata_operators": " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM documents WHERE {sql}" for k, sql in enumerate(OPERATOR_QUERIES.values())),
    "card_list": "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 = 4 AND p_partkey % 9 <> 0 AND p_partkey % 5 <> 0 AND (p_partkey % 4 > 1 OR p_partkey % 4 = 1 AND p_partkey % 7 >= 2) AND p_partkey % 4 < 3 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 9 = 0",
    "keyset_pages": "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '2023-06-01 00:00:00', 0) ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "version_latest": "SELECT p_partkey % 4 AS major, p_partkey % 7 AS minor, p_partkey AS patch FROM part WHERE p_partkey % 5 <> 0 AND (p_partkey % 4 > 1 OR p_partkey % 4 = 1 AND p_partkey % 7 >= 2) AND p_partkey % 4 < 3 ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 1",
}
