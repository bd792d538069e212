"""Progress of a streaming query as events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

from ..sources.events import STAGES


class Progress(StreamingQueryListener):
    """Tells ``emit`` how many of ``total`` rows the query of a name has read, after each micro-batch, and how it ended.

    Each event is one line of JSON, like those of ``sources.events``: progress from 0 to the total, then the line that
    ``result`` gives, or an error by its class. A run that is resumed goes on from ``done``.
    """

    def __init__(self, name: str, total: int, emit: Callable[[str], None], result: Callable[[], str] | None = None, stage: str = STAGES[1], done: int = 0) -> None:
        self._name, self._total, self._emit, self._result, self._stage, self.done = name, total, emit, result, stage, done
        self._run = None

    def _tell(self) -> None:
        self._emit(json.dumps({"type": "progress", "stage": self._stage, "done": min(self.done, self._total), "total": self._total}))

    def onQueryStarted(self, event) -> None:
        if event.name == self._name:
            self._run = event.runId
            self._tell()

    def onQueryProgress(self, event) -> None:
        if event.progress.runId == self._run and event.progress.numInputRows:
            self.done += event.progress.numInputRows
            self._tell()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId != self._run:
            return
        if event.exception:
            self._emit(json.dumps({"type": "error", "message": event.errorClassOnException or "failed"}))
        elif self._result:
            self._emit(self._result())
