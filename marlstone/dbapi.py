"""PEP 249 over the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import (  # noqa: F401
    DatabaseError, DataError, Error, IntegrityError, InterfaceError, InternalError, NotSupportedError, OperationalError, ProgrammingError, Warning,
)
from .graph.store import GraphStore
from .streaming.changes import ChangeStream

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


def connect(path: str, spark: SparkSession | None = None, autocommit: bool = True) -> Connection:
    return Connection(spark or SparkSession.builder.getOrCreate(), path, autocommit)


class Connection:
    """Without autocommit the first change opens a transaction, which commit() or rollback() ends; close() rolls back."""

    def __init__(self, spark: SparkSession, path: str, autocommit: bool):
        self.engine, self.autocommit, self.closed = Engine(spark, path), autocommit, False

    def _check(self) -> None:
        if self.closed:
            raise InterfaceError("the connection is closed")

    def cursor(self) -> Cursor:
        self._check()
        return Cursor(self)

    def execute(self, sql: str, args=()) -> Cursor:
        return self.cursor().execute(sql, args)

    def commit(self) -> None:
        self._check()
        if self.engine.txn:
            self.engine.sql("COMMIT")

    def rollback(self) -> None:
        self._check()
        if self.engine.txn:
            self.engine.sql("ROLLBACK")

    def graph(self, name: str) -> GraphStore:
        self._check()
        return GraphStore(self.engine.db, name)

    def subscribe(self, table: str | None = None) -> ChangeStream:
        self._check()
        return ChangeStream(self.engine.db, table)

    def close(self) -> None:
        if not self.closed:
            self.rollback()
            self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_rest) -> None:
        if kind is None:
            self.commit()
        self.close()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount = connection, None, -1
        self._rows: list[tuple] = []
        self._closed = False

    def execute(self, sql: str, args=()) -> Cursor:
        self.connection._check()
        if self._closed:
            raise InterfaceError("the cursor is closed")
        engine = self.connection.engine
        word = sql.lstrip().split(None, 1)[0].upper() if sql.strip() else ""
        if not self.connection.autocommit and not engine.txn and word in ("INSERT", "UPDATE", "DELETE", "COPY"):
            engine.sql("BEGIN")
        try:
            df = engine.sql(sql, list(args))
        except Error:
            raise
        except Exception as e:  # Spark's own errors
            raise ProgrammingError(str(e).split("\n")[0]) from e
        if df is None:
            self.description, self._rows, self.rowcount = None, [], engine.affected
        else:
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
            self._rows = [tuple(r) for r in df.collect()]
            self.rowcount = len(self._rows)
        return self

    def executemany(self, sql: str, rows) -> Cursor:
        """Inserts become one statement and so one commit."""
        import re

        from .engine import _bound

        rows = [list(r) for r in rows]
        m = re.match(r"(?is)^(\s*INSERT\s+INTO\b.*?\bVALUES)\s*(\(.*\))\s*;?\s*$", sql)
        if m and rows:
            return self.execute(m.group(1) + " " + ", ".join(_bound(m.group(2), r) for r in rows))
        total = 0
        for r in rows:
            total += max(self.execute(sql, r).rowcount, 0)
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        return self._rows.pop(0) if self._rows else None

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        n = size or self.arraysize
        out, self._rows = self._rows[:n], self._rows[n:]
        return out

    def fetchall(self) -> list[tuple]:
        out, self._rows = self._rows, []
        return out

    def __iter__(self):
        while (row := self.fetchone()) is not None:
            yield row

    def close(self) -> None:
        self._closed = True

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass
