"""Progress of streams and batch jobs."""

from __future__ import annotations

from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last state of every stream: add it with ``spark.streams.addListener``. ``report`` is called with each."""

    def __init__(self, report=None):
        self.report, self.states, self._lock = report, {}, Lock()

    def _set(self, key: str, **state) -> None:
        with self._lock:
            self.states[key] = self.states.get(key, {}) | state
            now = dict(self.states[key])
        if self.report:
            self.report(key, now)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._set(str(event.id), name=event.name, running=True, batches=0, rows=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            old = self.states.get(str(p.id), {})
        self._set(str(p.id), batches=old.get("batches", 0) + 1, rows=old.get("rows", 0) + p.numInputRows, rows_per_s=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._set(str(event.id), running=False, error=event.exception)


def seconds_left(done: float, whole: float, elapsed: float) -> float | None:
    """Seconds that the rest takes at the rate so far; None before anything is done."""
    return None if done <= 0 or whole <= 0 or elapsed < 0 else max(0.0, whole - done) * elapsed / done
