"""PostgreSQL, MySQL and TimescaleDB tables through Spark's JDBC source.

The driver jar comes with the Spark submission. Reads are split over `connections`
tasks by ranges of one column (for expired rows the date, up to the cutoff), writes use
the same number of connections, and the date filter is pushed into the database.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.names import sanitize
from coldkeep.model import KeyAuditFailed, RetentionError, UnknownTable
from coldkeep.operators.expire import expired
from coldkeep.session import written

# Identifier quote and driver class of each engine, by JDBC URL prefix, and the
# length of a name that both engines take.
_QUOTES = {"jdbc:postgresql:": '"', "jdbc:mysql:": "`"}
_DRIVERS = {"jdbc:postgresql:": "org.postgresql.Driver", "jdbc:mysql:": "com.mysql.cj.jdbc.Driver"}
_NAME_LENGTH = 63


@dataclass(frozen=True)
class JdbcSource:
    """Where a database is and how hard it may be used."""

    url: str
    schema: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    connections: int = 8
    fetch_size: int = 10_000
    batch_size: int = 1_000
    delete_size: int = 10_000

    def __post_init__(self):
        if not any(self.url.startswith(prefix) for prefix in _QUOTES):
            raise ValueError(f"unsupported database: {self.url}")
        if self.connections <= 0 or self.delete_size <= 0:
            raise ValueError("connections and delete_size must be positive")

    def options(self) -> dict[str, str]:
        out = {
            "url": self.url, "fetchsize": str(self.fetch_size), "batchsize": str(self.batch_size),
            "numPartitions": str(self.connections), "pushDownPredicate": "true", "preferTimestampNTZ": "true",
        }
        out["driver"] = self.driver_class()
        out.update({k: v for k, v in (("user", self.user), ("password", self.password)) if v})
        return out

    def driver_class(self) -> str:
        return self.driver or next(d for prefix, d in _DRIVERS.items() if self.url.startswith(prefix))

    def quote(self, name: str) -> str:
        mark = next(q for prefix, q in _QUOTES.items() if self.url.startswith(prefix))
        return f"{mark}{name.replace(mark, mark * 2)}{mark}"

    def qualified(self, table: str) -> str:
        return f"{self.quote(self.schema)}.{self.quote(table)}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def columns_sql(source: JdbcSource, table: str) -> str:
    """Name, type and nullability of a table's columns, of this schema only."""
    return (
        "SELECT column_name AS name, data_type AS type, is_nullable AS nullable, ordinal_position AS position "
        f"FROM information_schema.columns WHERE table_schema = {_text(source.schema)} AND table_name = {_text(table)}"
    )


def primary_key_sql(source: JdbcSource, table: str) -> str:
    """Columns of the primary key with their position in it."""
    return (
        "SELECT k.column_name AS name, k.ordinal_position AS position "
        "FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name "
        "AND c.table_name = k.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {_text(source.schema)} "
        f"AND c.table_name = {_text(table)}"
    )


def delete_sql(source: JdbcSource, table: str, staging: str, key: tuple[str, ...], portion: tuple[str, int] | None = None) -> str:
    """One set-based DELETE of the rows whose key was staged or, with (column, number), was staged in that portion."""
    target, keys = source.qualified(table), source.qualified(staging)
    match = " AND ".join(f"{keys}.{source.quote(k)} = {target}.{source.quote(k)}" for k in key)
    if portion is not None:
        match += f" AND {keys}.{source.quote(portion[0])} = {int(portion[1])}"
    return f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {keys} WHERE {match})"


def index_sql(source: JdbcSource, staging: str, column: str) -> str:
    """An index on one column of a staging table; it goes with the table."""
    mark = hashlib.sha256(staging.encode()).hexdigest()[:12]
    return f"CREATE INDEX {source.quote(f'portion_{mark}')} ON {source.qualified(staging)} ({source.quote(column)})"


def staging_name(table: str, run_id: str) -> str:
    """Name of the table for the keys that a run purges from one table; no two of them share one."""
    whole = f"{table}/{run_id}"
    mark = hashlib.sha256(whole.encode()).hexdigest()[:12]
    return f"purge_{mark}_{sanitize(whole)}"[:_NAME_LENGTH]


def bounds_sql(source: JdbcSource, table: str, column: str, before: datetime | None = None) -> str:
    """Smallest and largest value of a column, or the smallest before a time and that time."""
    name = source.quote(column)
    if before is None:
        return f"SELECT min({name}) AS low, max({name}) AS high FROM {source.qualified(table)}"
    return f"SELECT min({name}) AS low FROM {source.qualified(table)} WHERE {name} < {_text(before.isoformat(sep=' '))}"


class JdbcTable:
    """A database table used as hot table."""

    def __init__(self, spark: SparkSession, source: JdbcSource, table: str, split_column: str | None = None):
        self.spark = spark
        self.source = source
        self.table = table
        self.split_column = split_column

    def _query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.source.options()).option("query", sql).load()

    def columns(self) -> list[tuple[str, str, bool]]:
        """(name, database type, nullable) in table order."""
        rows = sorted(self._query(columns_sql(self.source, self.table)).collect(), key=lambda r: r["position"])
        if not rows:
            raise UnknownTable(f"schema {self.source.schema} shows no columns of {self.table}")
        return [(r["name"], r["type"].lower(), r["nullable"] == "YES") for r in rows]

    def primary_key(self) -> tuple[str, ...]:
        rows = sorted(self._query(primary_key_sql(self.source, self.table)).collect(), key=lambda r: r["position"])
        if not rows:
            raise KeyAuditFailed(f"{self.table}: the database declares no key to purge by")
        return tuple(r["name"] for r in rows)

    def split_options(self, date_column: str | None = None, cutoff: datetime | None = None) -> dict[str, str]:
        """Range split of a read: by the split column over all its values or, without one, by
        the date from its smallest value to the cutoff, where all wanted rows lie."""
        if self.split_column is not None:
            column, bounds = self.split_column, bounds_sql(self.source, self.table, self.split_column)
        elif date_column is not None:
            column, bounds = date_column, bounds_sql(self.source, self.table, date_column, cutoff)
        else:
            return {}
        found = self._query(bounds).first()
        if found["low"] is None:
            return {}
        high = found["high"] if self.split_column is not None else cutoff
        return {"partitionColumn": column, "lowerBound": str(found["low"]), "upperBound": str(high)}

    def df(self, date_column: str | None = None, cutoff: datetime | None = None) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.source.options())
        return reader.options(**self.split_options(date_column, cutoff)).option(
            "dbtable", self.source.qualified(self.table)).load()

    def schema(self) -> T.StructType:
        reader = self.spark.read.format("jdbc").options(**self.source.options())
        return reader.option("dbtable", self.source.qualified(self.table)).load().schema

    def count(self) -> int:
        return self.df().count()

    def expired(self, date_column: str, cutoff: datetime) -> DataFrame:
        """Expired rows, copied out of the database once.

        Everything later reads the copy, so a database that changes meanwhile cannot
        give two steps of a run different rows.
        """
        return written(self.spark, expired(self.df(date_column, cutoff), date_column, cutoff), "extract")

    def append(self, df: DataFrame, key: tuple[str, ...] = ()) -> None:
        """Insert rows by column name, in parallel batches; each task is one transaction."""
        target = self.source.qualified(self.table)
        df.write.format("jdbc").options(**self.source.options()).option("dbtable", target).mode("append").save()

    def delete_keys(self, keys: DataFrame, key: tuple[str, ...], run_id: str) -> int:
        """Stage the keys in a table of their own, delete by statements of about `delete_size` keys, drop the staging table.

        Each statement is a transaction, so locks and undo do not grow with the run. A purge that fails between
        two of them leaves rows that a repeat finds. The keys are dealt by a hash, which needs no order of them.
        A staging table that is there already belongs to somebody else or to a purge that died; it is an error.
        """
        portion = "portion"
        while portion.lower() in {k.lower() for k in key}:
            portion += "_"
        kept = written(self.spark, keys.select(*key).distinct(), "purge-keys")
        portions = -(-kept.count() // self.source.delete_size)
        if not portions:
            return 0
        staging = staging_name(self.table, run_id)
        target = self.source.qualified(staging)
        self._stage(kept.withColumn(portion, F.pmod(F.xxhash64(*key), F.lit(portions)).cast("int")), target)
        try:
            if portions > 1:
                self._execute(index_sql(self.source, staging, portion))
            return sum(self._execute(delete_sql(self.source, self.table, staging, key, (portion, n))) for n in range(portions))
        finally:
            self._execute(f"DROP TABLE {target}")

    def _stage(self, rows: DataFrame, target: str) -> None:
        rows.write.format("jdbc").options(**self.source.options()).option("dbtable", target).mode("errorifexists").save()

    def _execute(self, sql: str) -> int:
        """Run one statement in its own transaction from the driver."""
        jvm = self.spark._jvm
        login = jvm.java.util.Properties()
        for name, value in (("user", self.source.user), ("password", self.source.password)):
            if value:
                login.setProperty(name, value)
        # Asked directly: DriverManager does not see drivers that came with --jars.
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        connection = loader.loadClass(self.source.driver_class()).newInstance().connect(self.source.url, login)
        try:
            connection.setAutoCommit(False)
            changed = connection.createStatement().executeUpdate(sql)
            connection.commit()
            return changed
        except Exception as problem:
            connection.rollback()
            raise RetentionError(f"statement failed: {sql}") from problem
        finally:
            connection.close()
