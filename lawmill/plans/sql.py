"""Tables as views and the stock questions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views; any Spark SQL then works on them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query_file(spark: SparkSession, path: str, what: str = "*", kind: str = "parquet") -> DataFrame:
    """SQL straight on a file or folder."""
    return spark.sql(f"SELECT {what} FROM {kind}.`{path}`")


def ask(spark: SparkSession, question: str, **tables: DataFrame) -> DataFrame:
    """One of the stock questions over DataFrames, named as in its text; the session's own views stay as they are."""
    return spark.sql(question, **tables)


#: The stock questions: ``{bills}`` stands for the table.
BILLS_BY_STATE = "SELECT state, count(*) AS n FROM {bills} GROUP BY state ORDER BY n DESC, state"
BILLS_BY_SESSION = "SELECT state, session_id, count(*) AS n FROM {bills} GROUP BY state, session_id ORDER BY state, session_id"
DISTINCT_BY_CLASS = "SELECT class, count(DISTINCT bill_id) AS n FROM (SELECT bill_id, explode(classification) AS class FROM {bills}) GROUP BY class"
TOP_SPONSORS = "SELECT s.name, count(*) AS n FROM (SELECT explode(sponsorships) AS s FROM {bills}) WHERE s.primary GROUP BY s.name ORDER BY n DESC, s.name LIMIT 20"
MOST_ACTIVE = "SELECT bill_id, size(actions) AS n_actions, size(sponsorships) AS n_sponsors FROM {bills} ORDER BY n_actions DESC, bill_id"
PASSED_ACTIONS = "SELECT bill_id, a.date, a.description FROM (SELECT bill_id, explode(actions) AS a FROM {bills}) WHERE a.description ILIKE '%passed%'"
SAME_TITLE = "SELECT a.title, a.state AS state_a, b.state AS state_b FROM {bills} a JOIN {bills} b ON a.title = b.title AND a.state < b.state"
