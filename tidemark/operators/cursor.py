"""A cursor over live rows that moves both ways, fetching pages instead of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvalidCursor(RuntimeError):
    """The cursor stands on no row."""


class Cursor:
    """Cursor over (user_key, value) as they were when it was made. Not valid until positioned."""

    def __init__(self, rows: DataFrame, page: int = 1000, close=None, read=None):
        self.rows, self.page, self._close, self._read = rows, page, close, read
        self._buffer: list = []
        self._at = -1
        self._ascending = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if self._close:
            self._close()
            self._close = None

    def is_valid(self) -> bool:
        return 0 <= self._at < len(self._buffer)

    def _fetch(self, rows: DataFrame, ascending: bool) -> None:
        order = F.asc("user_key") if ascending else F.desc("user_key")
        self._buffer = [(r.user_key, r.value) for r in rows.orderBy(order).limit(self.page).collect()]
        self._ascending = ascending
        self._at = 0
        for key, value in self._buffer if self._read else ():
            self._read(key, len(key) + len(value))

    def seek(self, target) -> None:
        self._fetch(self.rows.where(F.col("user_key") >= F.lit(target)), True)

    def seek_to_first(self) -> None:
        self._fetch(self.rows, True)

    def seek_to_last(self) -> None:
        self._fetch(self.rows, False)

    def current(self):
        if not self.is_valid():
            raise InvalidCursor
        return self._buffer[self._at]

    def _step(self, ascending: bool):
        key = self.current()[0]
        step = 1 if ascending == self._ascending else -1
        if 0 <= self._at + step < len(self._buffer):
            self._at += step
        else:
            beyond = F.col("user_key") > F.lit(key) if ascending else F.col("user_key") < F.lit(key)
            self._fetch(self.rows.where(beyond), ascending)
        return self.current() if self.is_valid() else None

    def next(self):
        """Move to the following key; None, and no longer valid, at the end."""
        return self._step(True)

    def prev(self):
        """Move to the preceding key; None, and no longer valid, before the first."""
        return self._step(False)
