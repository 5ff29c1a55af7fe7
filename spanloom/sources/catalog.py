"""SQL over the tables of a store.

Each query sees the files that are live when it is asked: ``<table>`` has all rows, ``<table>_merged`` the newest of
each key and partition. Bounds on the arrival prune partitions of both, and only partitions that the query can need are
listed, once: the query is planned over tables without files first, and what its plan asks of ``partition`` right above
each of them says which these are.

Text from outside may be one SELECT or EXPLAIN of known plan nodes over the catalog's own tables, with built-in
functions, none of which runs Java methods, scripts or reads files.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.merge import newest
from spanloom.plans.pruning import between_received, prune
from spanloom.session import configure
from spanloom.sources.records import PARTITION, SPANS, RecordSpec, partition_value
from spanloom.sources.store import File, Store

log = logging.getLogger(__name__)

#: Nodes of a parsed plan that a query from outside may have.
NODES = """Project Filter Aggregate Join LateralJoin SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedSubqueryColumnAliases
Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except Window WithWindowDefinition UnresolvedHaving UnresolvedHint
Generate UnresolvedInlineTable OneRowRelation LocalRelation Pivot Unpivot Expand GroupingSets UnresolvedTableValuedFunction UnresolvedTVFAliases
Sample Tail UnionLoop CTERelationDef WithCTE""".split()
#: Built-in functions that it may not call.
FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "assert_true", "current_database", "current_schema", "current_catalog", "version"}
#: Table functions that it may call.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer", "sequence"}

_HOLDS: dict[str, Callable[[str, str], bool]] = {
    "EqualTo": lambda a, b: a == b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
}
_MIRRORED = {"EqualTo": "EqualTo", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}


class NotAQuery(ValueError):
    """The text is something else than one SELECT or EXPLAIN that may be asked."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _conjuncts(condition) -> list:
    return _conjuncts(condition.left()) + _conjuncts(condition.right()) if _kind(condition) == "And" else [condition]


def _test(condition) -> Callable[[str], bool]:
    """What a conjunct asks of a partition's value; always true where that isn't understood."""
    kind = _kind(condition)
    if kind in ("In", "InSet"):
        column = condition.value() if kind == "In" else condition.child()
        if _kind(column) == "AttributeReference" and column.name() == PARTITION:
            found = _items(condition.list()) if kind == "In" else _items(condition.hset().toSeq())
            values = [str(x.value()) if kind == "In" and _kind(x) == "Literal" else None if kind == "In" else str(x) for x in found]
            if None not in values:
                return lambda v: v in values
    elif kind in _HOLDS:
        column, bound = condition.left(), condition.right()
        if _kind(column) == "Literal":
            column, bound, kind = bound, column, _MIRRORED[kind]
        if _kind(column) == "AttributeReference" and column.name() == PARTITION and _kind(bound) == "Literal" and bound.value() is not None:
            value, holds = str(bound.value()), _HOLDS[kind]
            return lambda v: holds(v, value)
    return lambda v: True


def _needed(plan, names: list[str]) -> list[Callable[[str], bool]]:
    """For every scan of the table with these columns in an optimized plan, which partitions it needs."""
    out: list[Callable[[str], bool]] = []

    def walk(node, tests: list) -> None:
        if node.children().isEmpty():
            if {a.name() for a in _items(node.output())} <= set(names) and _kind(node) == "LogicalRDD":
                out.append(lambda v: all(t(v) for t in tests))
        else:
            kind = _kind(node)
            # Only conditions right above a scan, with nothing but columns left out in between, are its own.
            own = tests + [_test(c) for c in _conjuncts(node.condition())] if kind == "Filter" else tests if kind == "Project" and all(_kind(e) == "AttributeReference" for e in _items(node.projectList())) else []
            for child in _items(node.children()):
                walk(child, own)
        for inner in _items(node.subqueries()):
            walk(inner, [])

    walk(plan, [])
    return out


class Catalog:
    def __init__(self, spark: SparkSession, root: str, specs: Sequence[RecordSpec] = (SPANS,)):
        # A session of its own: its views and settings are nobody else's.
        self.spark, self.specs = configure(spark.newSession()), list(specs)
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.store = Store(self.spark, root)
        self._lock = threading.Lock()
        self._functions: set[str] = set()

    def _scoped(self, rows: DataFrame, spec: RecordSpec, merged: bool, organization_id: str | None, project_id: str | None) -> DataFrame:
        if organization_id is not None:
            rows = rows.where(F.col("organization_id") == organization_id)
        if project_id is not None:
            rows = rows.where(F.col("project_id") == project_id)
        return newest(rows, spec) if merged else rows

    def table(self, spec: RecordSpec = SPANS, merged: bool = False, organization_id: str | None = None, project_id: str | None = None, files: Sequence[File] | None = None) -> DataFrame:
        return self._scoped(self.store.read(spec, files), spec, merged, organization_id, project_id)

    def recent(self, since: datetime | None, values: tuple[str, str] | None = None, merged: bool = False, organization_id: str | None = None, project_id: str | None = None) -> DataFrame:
        """Spans that arrived since an instant, or in some partitions; no others are listed."""
        low, high = values or (partition_value(since) if since else "", "~")
        files = self.store.live_files(SPANS, [v for v in self.store.partitions(SPANS) if low <= v <= high])
        return between_received(self.table(SPANS, merged, organization_id, project_id, files), low=since)

    def _views(self, rows_of: Callable[[RecordSpec], DataFrame], scope: dict) -> None:
        for spec in self.specs:
            rows = rows_of(spec)
            self._scoped(rows, spec, False, **scope).createOrReplaceTempView(spec.table)
            self._scoped(rows, spec, True, **scope).createOrReplaceTempView(f"{spec.table}_merged")

    def _files(self, spec: RecordSpec, plan) -> list[File]:
        """The live files of the partitions that the plan needs."""
        try:
            needed = _needed(plan, [f.name for f in spec.read_schema.fields])
        except Exception as e:
            log.warning("all partitions are listed: %s", e)
            return self.store.live_files(spec)
        if not needed:
            return []
        return self.store.live_files(spec, [v for v in self.store.partitions(spec) if any(n(v) for n in needed)])

    def sql(self, query: str, args: dict | None = None, organization_id: str | None = None, project_id: str | None = None) -> DataFrame:
        """The query over fresh views, scoped to a tenant if one is given, pruned by arrival."""
        scope = {"organization_id": organization_id, "project_id": project_id}
        with self._lock:  # views belong to the session
            self._views(lambda spec: self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), spec.read_schema), scope)
            outline = prune(self.spark.sql(query, args=args))._jdf.queryExecution().optimizedPlan()
            files = {spec.table: self._files(spec, outline) for spec in self.specs}
            self._views(lambda spec: self.store.read(spec, files[spec.table]), scope)
            return prune(self.spark.sql(query, args=args))

    def select(self, query: str, **scope) -> DataFrame:
        """As ``sql``, for text from outside: one SELECT or EXPLAIN, nothing that writes, sets, creates or reads else."""
        explain = self._checked(query)
        if explain:
            inner = self.sql(explain[1], **scope)
            text = inner._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(explain[0]))
            return self.spark.createDataFrame([(text,)], "plan string")
        return self.sql(query, **scope)

    def _checked(self, query: str) -> tuple[str, str] | None:
        """(mode, query) of an EXPLAIN; None for a SELECT."""
        head = query.strip().split(None, 2)
        mode = None
        if head and head[0].lower() == "explain":
            rest = query.strip()[7:].strip()
            mode = "formatted"
            for word in ("extended", "formatted", "cost", "codegen", "simple"):
                if rest.lower().startswith(word + " "):
                    mode, rest = word, rest[len(word) :].strip()
            query = rest
        self._allowed(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query))
        return (mode, query) if mode else None

    def _allowed(self, plan) -> None:
        if not self._functions:
            found = self.spark._jsparkSession.sessionState().functionRegistry().listFunction()
            self._functions = {f.funcName().lower() for f in _items(found)} - FUNCTIONS
        tables = {n.lower() for spec in self.specs for n in (spec.table, f"{spec.table}_merged")}
        relations: list[str] = []

        def name(parts) -> str:
            found = _items(parts)
            if len(found) != 1:
                raise NotAQuery(f"there is no {'.'.join(found)} here")
            return found[0].lower()

        def expression(e) -> None:
            kind = _kind(e)
            if kind == "UnresolvedFunction" and name(e.nameParts()) not in self._functions or kind == "UnresolvedGenerator" and e.name().funcName().lower() not in TABLE_FUNCTIONS:
                raise NotAQuery("a function that may not be called")
            if kind in ("CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF"):
                raise NotAQuery("a function that may not be called")
            for child in _items(e.children()):
                expression(child)

        def walk(node) -> None:
            kind = _kind(node)
            if kind not in NODES:
                raise NotAQuery(f"only SELECT and EXPLAIN are answered, and no {kind}")
            if kind == "UnresolvedRelation":
                relations.append(name(node.multipartIdentifier()))
            if kind == "UnresolvedTableValuedFunction" and name(node.name()) not in TABLE_FUNCTIONS:
                raise NotAQuery("a table function that may not be called")
            if kind == "UnresolvedWith":
                for cte in _items(node.cteRelations()):
                    tables.add(cte._1().lower())
                    walk(cte._2())
            for e in _items(node.expressions()):
                expression(e)
            for child in [*_items(node.children()), *_items(node.subqueries())]:
                walk(child)

        walk(plan)
        for r in relations:
            if r not in tables:
                raise NotAQuery(f"there is no table {r}")
