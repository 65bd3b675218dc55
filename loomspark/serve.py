"""The read API: health, logs, anomalies, aggregate and metrics as functions, and over HTTP by the standard library."""

from __future__ import annotations

import json
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from loomspark import __version__
from loomspark.operators.metrics import default_registry
from loomspark.operators.store import GROUPS, LogStore, QueryFilters, list_anomalies


class BadRequest(ValueError):
    pass


def _limit(value) -> int:
    try:
        n = int(value)
    except (TypeError, ValueError) as e:
        raise BadRequest("limit must be a number") from e
    if not 1 <= n <= 10_000:
        raise BadRequest("limit must be between 1 and 10000")
    return n


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def health() -> dict:
    return {"status": "ok", "version": __version__}


def logs(store: LogStore, severity=None, source=None, pipeline_run_id=None, after=None, before=None, limit=100) -> list[dict]:
    """At most limit records; the limit bounds what reaches the driver."""
    for value in (after, before):
        if isinstance(value, str):
            try:
                datetime.fromisoformat(value)
            except ValueError as e:
                raise BadRequest(f"not a time: {value}") from e
    return _rows(store.query(QueryFilters(severity, source, pipeline_run_id, after, before, _limit(limit))))


def anomalies(store: LogStore, detector=None, limit=100) -> list[dict]:
    return _rows(list_anomalies(store.all_anomalies(), detector, _limit(limit)))


def aggregate(store: LogStore, group_by: str = "severity") -> list[dict]:
    if group_by not in GROUPS:
        raise BadRequest("group_by must be severity or source")
    return [{"key": str(r[group_by]), "count": r["count"]} for r in _rows(store.aggregate(group_by))]


def metrics() -> dict:
    return default_registry.snapshot()


def respond(store: LogStore | None, url: str) -> tuple[int, object]:
    """Status and body of a GET."""
    parts = urlsplit(url)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    try:
        if parts.path == "/health":
            return 200, health()
        if parts.path == "/metrics":
            return 200, metrics()
        known = {"/logs": logs, "/anomalies": anomalies, "/aggregate": aggregate}
        if parts.path not in known:
            return 404, {"detail": "not found"}
        if store is None:
            return 503, {"detail": "no repository"}
        return 200, known[parts.path](store, **query)
    except (BadRequest, TypeError) as e:
        return 422, {"detail": str(e)}


def server(store: LogStore | None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = respond(store, self.path)
            data = json.dumps(body, default=lambda x: x.isoformat() if isinstance(x, (date, datetime)) else str(x)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
