"""Jobs that can be stopped: from another thread, or by a deadline."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession


class Stopped(RuntimeError):
    """The work was cancelled or its time was over."""


class Stop:
    """Jobs started within `with stop:` carry a tag; `cancel` interrupts those that run, and no more are begun.

    The deadline, in seconds from the first `with`, is watched by a timer while jobs run. One Stop serves one piece of work of
    one thread; any thread may call `cancel`.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark, self.seconds = spark, seconds
        self.tag = f"lexmill-{uuid.uuid4().hex}"
        self.reason: str | None = None
        self._until: float | None = None
        self._timer: threading.Timer | None = None

    def cancel(self, reason: str = "cancelled") -> None:
        self.reason = self.reason or reason
        self.spark.interruptTag(self.tag)

    def check(self) -> None:
        """Raises Stopped if the work is to end."""
        if self._until is not None and time.monotonic() >= self._until:
            self.reason = self.reason or "deadline"
        if self.reason:
            raise Stopped(self.reason)

    def __enter__(self) -> Stop:
        if self.seconds is not None and self._until is None:
            self._until = time.monotonic() + self.seconds
        self.check()
        self.spark.addTag(self.tag)
        if self._until is not None:
            self._timer = threading.Timer(max(0.0, self._until - time.monotonic()), self.cancel, ["deadline"])
            self._timer.daemon = True
            self._timer.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.spark.removeTag(self.tag)
        if self._timer:
            self._timer.cancel()
            self._timer = None
        if self.reason and (kind is None or issubclass(kind, Exception)):
            raise Stopped(self.reason) from error
