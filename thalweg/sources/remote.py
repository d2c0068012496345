"""Rows to a remote store, all or nothing: ``df.write.format("remote_rows")`` after :func:`register`.

Each task sends its rows in batches to ``url/stage`` under a name of its own attempt; when all tasks are done, one message to ``url/commit``
names the attempts that count, and where a task fails for good, one to ``url/abort`` drops what was staged.  Rows of attempts that
failed, or ran twice, are named by no commit.  The driver sees names and counts only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of one request.
BATCH = 500


def post(url: str, body: dict, token: str | None, timeout: int) -> None:
    """Sends JSON; an error where it is refused."""
    import urllib.request

    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body, ensure_ascii=False, default=str).encode(), head), timeout=timeout):
        pass


@dataclass
class Sent(WriterCommitMessage):
    attempt: str
    rows: int


class RemoteWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.url, self.version, self.part = options["url"].rstrip("/"), options["version"], options["part"]
        self.token, self.timeout, self.names = options.get("token"), int(options.get("timeout", 60)), names

    def _send(self, step: str, **more) -> None:
        post(f"{self.url}/{step}", {"version": self.version, "part": self.part} | more, self.token, self.timeout)

    def write(self, iterator):
        attempt, rows, total = uuid.uuid4().hex, [], 0
        for row in iterator:
            rows.append(row.asDict(recursive=True))
            if len(rows) >= BATCH:
                self._send("stage", attempt=attempt, rows=rows)
                rows, total = [], total + len(rows)
        if rows:
            self._send("stage", attempt=attempt, rows=rows)
        return Sent(attempt, total + len(rows))

    def commit(self, messages):
        sent = [m for m in messages if m is not None]
        self._send("commit", attempts=sorted(m.attempt for m in sent if m.rows), rows=sum(m.rows for m in sent))

    def abort(self, messages):
        self._send("abort")


class RemoteRows(DataSource):
    """Options: ``url``, ``version``, ``part`` and, if wanted, ``token`` and ``timeout`` in seconds."""

    @classmethod
    def name(cls):
        return "remote_rows"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("versions are added, none is overwritten")
        return RemoteWriter(dict(self.options), schema.names)


def send_rows(df: DataFrame, url: str, version: str, part: str, token: str | None = None) -> None:
    """Sends one part of a version; an error where it was not taken whole."""
    df.sparkSession.dataSource.register(RemoteRows)
    writer = df.write.format("remote_rows").mode("append").option("url", url).option("version", version).option("part", part)
    (writer.option("token", token) if token else writer).save()


def send_diagram(nodes: DataFrame, edges: DataFrame, url: str, area: str, label: str = "", entered_by: str = "", token: str | None = None) -> str:
    """Sends a diagram of any size as a new version: nodes, then edges, then the one message that makes both visible.  Returns the version's id;
    after an error nothing of it is visible."""
    version = uuid.uuid4().hex
    send_rows(nodes, url, version, "nodes", token)
    send_rows(edges, url, version, "edges", token)
    post(f"{url.rstrip('/')}/publish", {"version": version, "p_tambon_id": area, "p_label": label, "p_entered_by": entered_by}, token, 60)
    return version
