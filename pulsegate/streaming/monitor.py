"""Rate of running queries against a target, from the engine's own progress events."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

from pulsegate.operators.audit import WARN_SHARE

LOG = logging.getLogger(__name__)


class RateListener(StreamingQueryListener):
    """Reports each micro-batch: rows per second, share of the target, running average; warns under 90 %."""

    def __init__(self, target_per_second: float, report: Callable[[dict], None] | None = None):
        self.target = target_per_second
        self.report = report or (lambda line: LOG.log(logging.WARNING if line["warning"] else logging.INFO, "%s", line))
        self.rows: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.failures = 0

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)], self.seconds[str(event.id)] = 0, 0.0

    def onQueryProgress(self, event) -> None:
        progress, query = event.progress, str(event.progress.id)
        seconds = progress.batchDuration / 1000
        if not progress.numInputRows or seconds <= 0:
            return
        self.rows[query] = self.rows.get(query, 0) + progress.numInputRows
        self.seconds[query] = self.seconds.get(query, 0.0) + seconds
        rate = progress.numInputRows / seconds
        self.report({
            "query": query, "batch": progress.batchId, "rows": progress.numInputRows, "rate": rate,
            "share_of_target": rate / self.target, "average_rate": self.rows[query] / self.seconds[query],
            "failures": self.failures, "warning": rate < WARN_SHARE * self.target,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None
