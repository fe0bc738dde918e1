"""Keep streaming queries running: a failed one starts again from its checkpoint, or all of them stop."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql.streaming import StreamingQuery


class StageFailed(RuntimeError):
    """A stage failed more often than it may be restarted; `stage` is its name."""

    def __init__(self, stage: str, failures: int, error: BaseException):
        super().__init__(f"{stage} failed {failures} times: {error}")
        self.stage = stage


class Supervisor:
    """Starts a query per name and watches them.

    `starts[name]()` must resume from a checkpoint of its own, so that a restart neither loses nor repeats
    what a committed sink holds. A query that fails is started again up to `restarts` times, after `pause`
    seconds the first time and twice as long each further one; the others run on meanwhile. One that fails
    once more stops all of them. A query that ends by itself, or is stopped, has finished.
    """

    def __init__(
        self,
        starts: Mapping[str, Callable[[], StreamingQuery]],
        restarts: int = 3,
        pause: float = 1.0,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.starts, self.restarts, self.pause, self.clock = dict(starts), restarts, pause, clock
        self.failures: Counter[str] = Counter()
        self.queries: dict[str, StreamingQuery] = {}
        self._due: dict[str, float] = dict.fromkeys(self.starts, clock())
        self._open = set(self.starts)

    def check(self) -> bool:
        """Look at every query once and start what is due; False when all have finished."""
        for name in list(self.starts):
            if name not in self._open:
                continue
            if name in self._due:
                if self.clock() >= self._due[name]:
                    self._start(name)
            elif not self.queries[name].isActive:
                error = self.queries[name].exception()
                if error is None:
                    self._open.discard(name)
                else:
                    self._failed(name, error)
        return bool(self._open)

    def run(self, every: float = 0.2) -> dict[str, StreamingQuery]:
        """Watch until all have finished; the last query of each name."""
        try:
            while self.check():
                time.sleep(every)
        except BaseException:
            self.stop()
            raise
        return self.queries

    def stop(self) -> None:
        """Stop every query and start none again."""
        self._open.clear()
        self._due.clear()
        for query in self.queries.values():
            if query.isActive:
                query.stop()

    def _start(self, name: str) -> None:
        del self._due[name]
        try:
            self.queries[name] = self.starts[name]()
        except PySparkException as error:
            self._failed(name, error)

    def _failed(self, name: str, error: BaseException) -> None:
        self.failures[name] += 1
        if self.failures[name] > self.restarts:
            self.stop()
            raise StageFailed(name, self.failures[name], error) from error
        self._due[name] = self.clock() + self.pause * 2 ** (self.failures[name] - 1)
