import pytest
from pyspark.errors import PySparkException

from helpers import candles, rates
from tickloom.plans.sql import check_select, raw_sql, raw_sql_over
from tickloom.sources import sinks


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sql"))
    sinks.write_candles(candles(spark, *[{"timestamp": f"2024-01-01T0{h}:00:00"} for h in range(5)]), root)
    sinks.write_funding(rates(spark, {}), root)
    return root


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1",
        "  select 1",
        "WITH q AS (SELECT 1 AS a) SELECT a FROM q",
        "-- note\nSELECT 1",
        "/* note; */ SELECT 'a;b', 'it''s; fine', \"c;d\"",
        "SELECT symbol, rank() OVER w FROM Candles WINDOW w AS (ORDER BY open) LIMIT 3",
        "SELECT * FROM candles c JOIN (SELECT max(open) m FROM candles) d ON c.open = d.m",
        "WITH a AS (SELECT 1 x), b AS (SELECT x FROM a) SELECT x FROM b UNION ALL SELECT 2",
        "SELECT (SELECT count(*) FROM candles) n WHERE EXISTS (SELECT 1 FROM candles)",
        "SELECT explode(array(1, 2)) e, CASE WHEN 1 = 1 THEN 'a' END -- end",
        "SELECT symbol FROM candles GROUP BY symbol HAVING count(*) > 1 ORDER BY 1",
    ],
)
def test_accepted(spark, sql):
    assert check_select(spark, sql, ["candles"]) == sql


@pytest.mark.parametrize(
    "sql",
    [
        "",
        "DROP TABLE candles",
        "INSERT INTO candles SELECT 1",
        "-- SELECT\nDELETE FROM candles",
        "SELECT 1; DROP TABLE candles",
        "SELECT 1;",
        "SELECT ''';' ; SELECT 2",
        "SELECT java_method('java.lang.System', 'exit', 0)",
        "SELECT reflect ('a', 'b')",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT * FROM parquet . `/data`",
        "WITH q AS (SELECT 1 a) INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT * FROM q",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT '--' AS a, reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT 1 WHERE EXISTS (SELECT reflect('a', 'b'))",
        "SELECT * FROM hidden",
        "SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT * FROM hidden)",
        "SELECT (SELECT max(a) FROM hidden)",
        "SELECT * FROM spark_catalog.default.candles",
        "SHOW TABLES",
        "CACHE TABLE candles",
        "SELECT 1) x; SELECT (2",
    ],
)
def test_refused(spark, sql):
    with pytest.raises(ValueError):
        check_select(spark, sql, ["candles"])


def test_views_of_the_user_stay(spark, root):
    spark.range(3).createOrReplaceTempView("candles")
    try:
        assert raw_sql(spark, "SELECT * FROM candles", root).count() == 5
        assert spark.table("candles").count() == 3
    finally:
        spark.catalog.dropTempView("candles")


def test_frames_of_the_callers_session(spark):
    frame = spark.range(4).withColumnRenamed("id", "n")
    got = raw_sql_over(spark, "SELECT sum(n) AS total FROM mine", {"mine": frame})
    assert str(got.first()["total"]) == "6"


def test_results_are_text_and_capped(spark, root):
    rows = raw_sql(spark, "SELECT timestamp, open FROM candles ORDER BY timestamp", root, limit=2)
    assert [tuple(r) for r in rows.collect()] == [
        ("2024-01-01T00:00:00", "10.0000000000"),
        ("2024-01-01T01:00:00", "10.0000000000"),
    ]
    assert raw_sql(spark, "SELECT * FROM candles", root, limit=0).count() == 5
    assert raw_sql(spark, "SELECT * FROM funding_rates", root).count() == 1
    assert raw_sql(spark, "SELECT * FROM dataset_summary", root).count() == 2


def test_paths_are_no_tables_and_views_do_not_leak(spark, root):
    with pytest.raises(ValueError):
        raw_sql(spark, f"SELECT * FROM `parquet`.`{root}`", root).collect()
    raw_sql(spark, "SELECT 1 AS a", root)
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM candles").collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
