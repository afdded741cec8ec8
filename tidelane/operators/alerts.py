"""Handlers of alerts: callbacks and logs, each of which may fail without stopping the others."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from .model import AlertLevel

_LOG = logging.getLogger("tidelane.alerts")
_LEVELS = {
    AlertLevel.INFO: logging.INFO, AlertLevel.WARNING: logging.WARNING, AlertLevel.CRITICAL: logging.CRITICAL, AlertLevel.EMERGENCY: logging.CRITICAL
}


def log_alerts(alerts: DataFrame, most: int = 100) -> None:
    """Writes the first `most` alerts of a batch to the log, by level; the table holds them all."""
    for r in alerts.orderBy("timestamp_ns", "event_id").limit(most).collect():
        _LOG.log(_LEVELS[AlertLevel(r.level)], "[%s] %s - %s", "EMERGENCY" if r.level == AlertLevel.EMERGENCY else "ALERT", r.source, r.message)


class Alerts:
    """Named functions that get each batch's alerts as a DataFrame; what one raises is kept in `errors`."""

    def __init__(self, **handlers: Callable[[DataFrame], None]) -> None:
        self.handlers = dict(handlers)
        self.errors: list[tuple[str, Exception]] = []

    def add(self, name: str, handler: Callable[[DataFrame], None]) -> Alerts:
        self.handlers[name] = handler
        return self

    def raise_all(self, alerts: DataFrame) -> None:
        for name, handler in self.handlers.items():
            try:
                handler(alerts)
            except Exception as e:  # noqa: BLE001  one handler must not stop the others
                self.errors.append((name, e))
