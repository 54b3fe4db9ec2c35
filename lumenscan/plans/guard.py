"""Read-only SQL: the parsed plan is walked over an allow-list before anything is analysed.

Statements are parsed by the engine that runs them, so there is no second grammar to disagree with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

MOST_CHARS = 20_000

# The plan nodes of reading queries.
NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedRelation LocalRelation OneRowRelation UnresolvedInlineTable Generate Sample Pivot Unpivot Window WithWindowDefinition UnresolvedHint "
    "UnresolvedTableValuedFunction Tail UnresolvedOrderBy UnresolvedGroupingAnalytics".split()
)
# Functions that leave the data: they call code, read files or the environment, or wait.
DENIED = frozenset(
    "reflect java_method try_reflect read_files input_file_name input_file_block_start input_file_block_length current_user user session_user current_database current_catalog current_schema "
    "version spark_partition_id assert_true raise_error sleep secret try_secret http_request ai_query from_avro to_avro schema_of_avro from_protobuf to_protobuf uuid".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class StatementRejected(ValueError):
    code = "STATEMENT_REJECTED"


def _iterate(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def check(spark: SparkSession, text: str, tables: Iterable[str]) -> set[str]:
    """Names of the tables that the statement reads; raises if it is anything but a query over these tables."""
    if len(text) > MOST_CHARS:
        raise StatementRejected(f"the statement is longer than {MOST_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:
        raise StatementRejected("this is no single statement") from None
    allowed, used, ctes = {t.lower() for t in tables}, set(), set()
    relations: list[list[str]] = []

    def name_of(seq) -> list[str]:
        return [str(x) for x in _iterate(seq)]

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = name_of(e.nameParts())
            if len(parts) > 1 or parts[0].lower() in DENIED:
                raise StatementRejected(f"the function {'.'.join(parts)} is not allowed")
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "InSubquery"):
            inner = e.plan() if kind != "InSubquery" else None
            if inner is not None:
                node(inner)
        for child in _iterate(e.children()):
            expression(child)

    def node(p) -> None:
        kind = p.getClass().getSimpleName()
        if kind not in NODES:
            raise StatementRejected(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            relations.append(name_of(p.multipartIdentifier()))
        if kind == "UnresolvedTableValuedFunction" and ".".join(name_of(p.name())).lower() not in TABLE_FUNCTIONS:
            raise StatementRejected("the table function is not allowed")
        if kind == "UnresolvedWith":
            for pair in _iterate(p.cteRelations()):
                ctes.add(str(pair._1()).lower())
                node(pair._2())
        for child in _iterate(p.children()):
            node(child)
        for child in _iterate(p.innerChildren()):
            if hasattr(child, "children") and "logical" in child.getClass().getName():
                node(child)
        for e in _iterate(p.expressions()):
            expression(e)

    node(plan)
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in allowed | ctes:
            raise StatementRejected(f"no such table: {'.'.join(parts)}")
        used.add(parts[0].lower())
    return used - ctes


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The checked statement over temporary views of the tables."""
    check(spark, text, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    found = spark.sql(text)
    return found.limit(limit) if limit is not None else found
