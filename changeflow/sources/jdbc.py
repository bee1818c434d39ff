"""SRC-2 / SRC-3: relational sources over JDBC, read in key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Driver classes of the two relational sources (the jars must be on the classpath).
POSTGRES_DRIVER = "org.postgresql.Driver"
SQLSERVER_DRIVER = "com.microsoft.sqlserver.jdbc.SQLServerDriver"


def postgres_url(host: str, port: int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def sqlserver_url(host: str, port: int, database: str, encrypt: bool = False) -> str:
    return f"jdbc:sqlserver://{host}:{port};databaseName={database};encrypt={'true' if encrypt else 'false'}"


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Read ``table`` in ``partitions`` parallel key ranges.

    Each task issues ``WHERE key >= a AND key < b``; filters and projections on
    the result are pushed into those statements by Spark's JDBC source.
    """
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetch_size))
    return spark.read.jdbc(
        url=url,
        table=table,
        column=key,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=props,
    )


def key_bounds(spark: SparkSession, url: str, table: str, key: str, properties: dict | None = None) -> tuple:
    """``(MIN(key), MAX(key))`` computed by the database: one row comes back.

    The key is a quoted identifier, as Spark's JDBC writer creates columns.
    """
    col = '"' + key.replace('"', '""') + '"'
    q = f"(SELECT MIN({col}) AS lo, MAX({col}) AS hi FROM {table}) bounds"
    row = spark.read.jdbc(url=url, table=q, properties=dict(properties or {})).first()
    return row[0], row[1]


def scan_jdbc_auto(spark: SparkSession, url: str, table: str, key: str, partitions: int,
                   properties: dict | None = None) -> DataFrame:
    """``scan_jdbc`` with bounds from ``key_bounds`` (an empty table reads as one range)."""
    lo, hi = key_bounds(spark, url, table, key, properties)
    if lo is None:
        lo, hi = 0, 0
    return scan_jdbc(spark, url, table, key, int(lo), int(hi) + 1, partitions, properties)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def string_cuts(spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict | None = None) -> list[str]:
    """Up to ``partitions - 1`` keys that cut ``table`` into ranges of like size, found by the database.

    One count, then one key per cut by its place in key order; only these rows come back.
    """
    props, col = dict(properties or {}), _quoted(key)
    n = spark.read.jdbc(url=url, table=f"(SELECT COUNT(*) AS n FROM {table}) counted", properties=props).first()[0]
    places = sorted({n * i // partitions for i in range(1, partitions)} - {0, n})
    cuts = [spark.read.jdbc(url=url, table=f"(SELECT {col} AS k FROM {table} ORDER BY {col} OFFSET {p} ROWS FETCH NEXT 1 ROWS ONLY) cut", properties=props).first()[0]
            for p in places]
    return [c for c in dict.fromkeys(cuts) if c is not None]


def scan_jdbc_strings(spark: SparkSession, url: str, table: str, key: str, cuts: list[str],
                      properties: dict | None = None, fetch_size: int = 10_000) -> DataFrame:
    """SRC-3: read a table with a string key in parallel ranges between ``cuts``.

    The comparisons run in the database, so its collation decides the order and
    every row (a NULL key in the first range) is in exactly one range.
    """
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetch_size))
    col, text = _quoted(key), ["'" + c.replace("'", "''") + "'" for c in cuts]
    if not text:
        return spark.read.jdbc(url=url, table=table, properties=props)
    ranges = [f"{col} < {text[0]} OR {col} IS NULL", *[f"{col} >= {a} AND {col} < {b}" for a, b in zip(text, text[1:])], f"{col} >= {text[-1]}"]
    return spark.read.jdbc(url=url, table=table, predicates=ranges, properties=props)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None,
               batch_size: int = 10_000) -> None:
    """SNK-1 against a relational target: batched INSERTs, one connection per task."""
    props = dict(properties or {})
    props.setdefault("batchsize", str(batch_size))
    df.write.jdbc(url=url, table=table, mode=mode, properties=props)
