"""Read-only SQL over the stored records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.cast import result_strings
from tickloom.operators.select import DEFAULT_LIMIT, row_cap
from tickloom.operators.summary import dataset_summary
from tickloom.schemas import CANDLE, FUNDING
from tickloom.session import configure
from tickloom.sources.store import scan

# Parsed statements may consist of these steps only: they read, and nothing else.
QUERY_STEPS = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit "
    "Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving "
    "UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases "
    "UnresolvedWith WithWindowDefinition".split()
)
# Functions that run code, or tell about files and the session.
BLOCKED_FUNCTIONS = frozenset(
    "current_catalog current_database current_schema current_user input_file_block_length "
    "input_file_block_start input_file_name java_method reflect session_user try_reflect user "
    "version".split()
)
SUBQUERIES = frozenset(
    "Exists FunctionTableSubqueryArgumentExpression LateralSubquery ListQuery ScalarSubquery".split()
)
Views = dict[str, DataFrame] | Callable[[SparkSession], dict[str, DataFrame]]


def _each(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(node, views: frozenset[str]) -> None:
    kind = _kind(node)
    if kind == "UnresolvedFunction":
        name = [str(part).lower() for part in _each(node.nameParts())]
        if len(name) > 1 or name[0] in BLOCKED_FUNCTIONS:
            raise ValueError("Query contains blocked functions.")
    for child in _each(node.children()):
        _check_expression(child, views)
    if kind in SUBQUERIES:
        _check_step(node.plan(), views)


def _check_step(node, views: frozenset[str]) -> None:
    kind = _kind(node)
    if kind not in QUERY_STEPS:
        raise ValueError("Only SELECT (or WITH … SELECT) statements are permitted.")
    if kind == "UnresolvedRelation":
        name = [str(part).lower() for part in _each(node.multipartIdentifier())]
        if len(name) != 1 or name[0] not in views:
            raise ValueError("Only the registered views can be queried.")
    if kind == "UnresolvedWith":
        # A name is known to the queries that follow it and to the statement itself.
        for pair in _each(node.cteRelations()):
            _check_step(pair._2(), views)
            views = views | {str(pair._1()).lower()}
    for expression in _each(node.expressions()):
        _check_expression(expression, views)
    for child in _each(node.children()):
        _check_step(child, views)


def check_select(spark: SparkSession, sql: str, views: Sequence[str]) -> str:
    """Accept one query over the named views; raise for anything else.

    Spark's own parser reads the statement, so that comments, quotes and nesting mean here
    what they mean when it runs.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
        # Only a single query without a final semicolon can stand in brackets.
        parser.parsePlan(f"SELECT * FROM ({sql}\n)")
    except ParseException as error:
        if ";" in sql:
            raise ValueError("Multiple SQL statements are not permitted.") from error
        raise ValueError("Only SELECT (or WITH … SELECT) statements are permitted.") from error
    _check_step(plan, frozenset(name.lower() for name in views))
    return sql


def sql_session(spark: SparkSession) -> SparkSession:
    """A session of its own: other views are not seen, and none is replaced."""
    session = configure(spark.newSession())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set(
        "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    )
    return session


def raw_sql_over(
    spark: SparkSession, sql: str, views: Views, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Run a checked statement over the given views; 0 rows as limit means all.

    The limit is part of the plan, so Spark stops early instead of cutting a
    finished result.
    """
    session = sql_session(spark)
    if callable(views):
        views = views(session)
    check_select(spark, sql, list(views))
    for name, frame in views.items():
        _adopt(session, frame).createOrReplaceTempView(name)
    return row_cap(result_strings(session.sql(sql)), limit)


def _adopt(session: SparkSession, frame: DataFrame) -> DataFrame:
    """The same plan as a frame of another session of this application."""
    if frame.sparkSession is session:
        return frame
    plan = frame._jdf.queryExecution().logical()
    dataset = session._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(session._jsparkSession, plan), session)


def raw_sql(
    spark: SparkSession, sql: str, root: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """SQL over ``candles``, ``funding_rates`` and ``dataset_summary`` of a store."""

    def views(session: SparkSession) -> dict[str, DataFrame]:
        found = {
            "candles": scan(session, root, CANDLE),
            "funding_rates": scan(session, root, FUNDING),
        }
        # The summary lists the store's files, which is not worth it for other statements.
        if "dataset_summary" in sql.lower():
            found["dataset_summary"] = dataset_summary(session, root)
        return found

    return raw_sql_over(spark, sql, views, limit)
