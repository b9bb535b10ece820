"""Log lines as JSON, one object a line, and a listener that writes a line for each batch of a stream."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

# What a record may carry beside its message.
FIELDS = ("ingest_id", "source", "batch_size", "accepted", "rejected", "duration_ms")
QUIET = ("py4j", "urllib3", "kafka", "paho")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        when = datetime.fromtimestamp(record.created, UTC).isoformat().replace("+00:00", "Z")
        line = {"timestamp": when, "level": record.levelname, "logger": record.name, "message": record.getMessage(), "module": record.module, "function": record.funcName, "line": record.lineno}
        line |= {name: getattr(record, name) for name in FIELDS if hasattr(record, name)}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def set_up(level: str = "INFO", structured: bool = True, stream: TextIO | None = None) -> logging.Handler:
    """Sends all log records of the level and above to the stream (standard output), as JSON or as plain lines."""
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines() if structured else logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)
    for name in QUIET:
        logging.getLogger(name).setLevel(logging.WARNING)
    return handler


class BatchLog(StreamingQueryListener):
    """One line for each batch of every stream of the session: spark.streams.addListener(BatchLog())."""

    def __init__(self, name: str = "tracksmith.streams") -> None:
        self.log = logging.getLogger(name)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.log.info("stream started", extra={"source": str(event.id)})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.log.info("batch %d", p.batchId, extra={"source": str(p.id), "batch_size": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution")})

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.log.log(logging.ERROR if event.exception else logging.INFO, "stream ended%s", f": {event.exception}" if event.exception else "", extra={"source": str(event.id)})
