"""A DB-API 2.0 connection (PEP 249) over an engine: connect(), cursors, ? parameters, typed rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    """Any failure of this interface."""


class NotSupportedError(Error):
    """The engine has no transactions."""


class Cursor:
    arraysize = 1000

    def __init__(self, engine):
        self._engine, self._rows, self.description, self.rowcount = engine, None, None, -1

    def execute(self, sql: str, parameters: Sequence[Any] = ()) -> Cursor:
        df = self._engine.sql(sql, list(parameters))
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema.fields]
        self._rows: Iterator = (tuple(r) for r in df.toLocalIterator())
        return self

    def executemany(self, sql: str, many: Sequence[Sequence[Any]]) -> Cursor:
        for parameters in many:
            self.execute(sql, parameters)
        return self

    def fetchone(self) -> tuple | None:
        return next(self._need(), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        rows = self._need()
        return [r for _, r in zip(range(size or self.arraysize), rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._need())

    def __iter__(self) -> Iterator[tuple]:
        return self._need()

    def _need(self) -> Iterator[tuple]:
        if self._rows is None:
            raise Error("nothing has been executed")
        return self._rows

    def close(self) -> None:
        self._rows = None

    def setinputsizes(self, sizes) -> None: ...

    def setoutputsize(self, size, column=None) -> None: ...


class Connection:
    def __init__(self, engine):
        self._engine = engine

    def cursor(self) -> Cursor:
        if self._engine is None:
            raise Error("the connection is closed")
        return Cursor(self._engine)

    def commit(self) -> None: ...

    def rollback(self) -> None:
        raise NotSupportedError("there are no transactions")

    def close(self) -> None:
        self._engine = None


def connect(engine) -> Connection:
    return Connection(engine)
