"""Read-only SQL over the logical relations, admitted by what Spark's own parser makes of it."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The relations a query may read, and its bounds.
RELATIONS = ("project", "files", "symbols", "edges", "reference_sites", "numerical_sites", "search_documents", "symbol_coverage", "file_history", "file_cochanges", "agent_artifacts")
MAX_TEXT, MAX_ROWS, MAX_ROW_CHARS = 64 << 10, 1_000, 4_096
#: Nodes of a parsed plan that only read; whatever else a statement parses to is refused.
PLANS = frozenset(
    "Project Filter UnresolvedHaving Aggregate Distinct Deduplicate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Except Intersect SubqueryAlias UnresolvedWith WithWindowDefinition "
    "UnresolvedRelation OneRowRelation LocalRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction Generate Pivot Unpivot UnresolvedOrdinal Window ExplainCommand".split()
)
#: Functions that reach outside the relations; table functions that make rows of what they are given.
OUTSIDE = re.compile(r"reflect|java_method|^input_file|^current_|^session_user$|^user$|^version$|^raise_error$|^sleep$|^read_files$|^http")
TABLE_FUNCTIONS = frozenset(["explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "range", "stack"])


class QueryRefused(ValueError):
    """The text isn't a read-only query over the logical relations."""


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _admit(gateway, node, named: frozenset[str]) -> None:
    """Raise unless a parsed plan or expression and all below it only read; `named` are the names that WITH gives."""
    kind = node.getClass().getSimpleName()
    plan = is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    if plan and kind not in PLANS:
        raise QueryRefused(f"only queries are admitted, not {kind}")
    if kind == "UnresolvedRelation":
        parts = [str(p).lower() for p in _seq(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in RELATIONS and parts[0] not in named:
            raise QueryRefused(f"no such relation: {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction" and str(node.name().apply(0)).lower() not in TABLE_FUNCTIONS:
        raise QueryRefused(f"no such table function: {node.name().apply(0)}")
    if kind == "UnresolvedFunction" and OUTSIDE.search(str(node.nameParts().last()).lower()):
        raise QueryRefused(f"not allowed: {node.nameParts().last()}")
    if kind == "UnresolvedWith":
        named = named | {str(x._1()).lower() for x in _seq(node.cteRelations())}
    if kind == "ExplainCommand":
        _admit(gateway, node.logicalPlan(), named)
        return
    for child in _seq(node.children()) + _seq(node.innerChildren()) + (_seq(node.expressions()) if plan else []):
        _admit(gateway, child, named)


def validate(spark: SparkSession, text: str) -> str:
    """The text without a last semicolon, or QueryRefused."""
    sql = text.strip().removesuffix(";").rstrip()
    if len(sql.encode()) > MAX_TEXT:
        raise QueryRefused("too long")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", sql):
        raise QueryRefused("control character")
    outside = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if re.search(r"""["$;`]|--|/\*""", outside) or outside.count("'") % 2:
        raise QueryRefused("quoting, comments and separators aren't allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryRefused("no SQL query") from e
    _admit(spark.sparkContext._gateway, plan, frozenset())
    return sql


def run(spark: SparkSession, text: str, relations: dict[str, DataFrame], limit: int = MAX_ROWS) -> DataFrame:
    """(row) of JSON objects, at most limit + 1 so that a caller sees whether there are more; longer rows are cut.

    The limits are those of an interactive surface. Relations not given are empty names to the query and fail to
    resolve.
    """
    sql = validate(spark, text)
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql).limit(min(limit, MAX_ROWS) + 1)
    return out.select(F.substring(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 1, MAX_ROW_CHARS).alias("row"))
