"""Messages to users: a sender with error checks, and a sink for batches and streams that marks what was sent.

    spark.dataSource.register(messages.Messages)
    rows.write.format("messages").option("endpoint", url).option("token", token).option("marks", folder).mode("append").save()

rows: chat_id, text and the key columns that name a message (user_id, group_key, target by default). A message that fails does
not keep others from being sent, and doesn't hide them: what was sent is marked, then the write fails. The next write leaves
out what the marks hold (see unsent). A task that is lost before it reports is the only one whose messages can be sent again.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

KEYS = ("user_id", "group_key", "target")
TIMEOUT = 20.0


class DeliveryError(RuntimeError):
    pass


def post(endpoint: str, token: str, chat_id: int, text: str, timeout: float = TIMEOUT) -> None:
    """Send one message; an HTTP status from 400 on, an answer that isn't ok, or none at all is a DeliveryError."""
    if not token:
        raise ValueError("a token is required")
    form = urllib.parse.urlencode({"chat_id": chat_id, "text": text, "parse_mode": "HTML"}).encode()
    try:
        with urllib.request.urlopen(f"{endpoint.rstrip('/')}/bot{token}/sendMessage", form, timeout) as answer:
            body = json.loads(answer.read() or b"null")
    except urllib.error.HTTPError as e:
        raise DeliveryError(f"HTTP status {e.code}") from None
    except (OSError, ValueError) as e:
        raise DeliveryError(f"no answer: {e}") from None
    if not isinstance(body, dict) or not body.get("ok"):
        raise DeliveryError("the message was rejected")


def sender(endpoint: str, token: str) -> Callable[[Row], None]:
    """A function that sends a row (chat_id, text), for jobs.deliver."""
    if not token:
        raise ValueError("a token is required")
    return lambda row: post(endpoint, token, row["chat_id"], row["text"])


@dataclass
class Sent(WriterCommitMessage):
    """What one task sent, as JSON keys, and the errors of what it could not send."""

    keys: list[str]
    errors: list[str]


class _Writing:
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.endpoint, self.token, self.marks = (options.get(k) for k in ("endpoint", "token", "marks"))
        self.keys = [k for k in options.get("keys", ",".join(KEYS)).split(",") if k in columns]
        missing = [k for k in ("endpoint", "token", "marks") if not options.get(k)] + [c for c in ("chat_id", "text") if c not in columns]
        if missing or not self.keys:
            raise ValueError(f"options endpoint, token and marks, columns chat_id and text and a key are required; missing: {', '.join(missing) or 'a key'}")

    def send(self, rows: Iterator[Row]) -> Sent:
        found = Sent([], [])
        for row in rows:
            key = json.dumps({k: row[k] if isinstance(row[k], (int, str, type(None))) else str(row[k]) for k in self.keys}, ensure_ascii=False)
            try:
                post(self.endpoint, self.token, row["chat_id"], row["text"])
                found.keys.append(key)
            except DeliveryError as e:
                found.errors.append(f"{key}: {e}")
        return found

    def mark(self, reports: list[Sent | None]) -> list[str]:
        """Write one file of marks; the errors of all reports. A task that was lost has none."""
        from pyarrow import fs

        keys = [k for r in reports if r for k in r.keys]
        if keys:
            store, folder = fs.FileSystem.from_uri(self.marks)
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json") as out:
                out.write("".join(f"{k}\n" for k in keys).encode())
        return [e for r in reports if r for e in r.errors]

    def finish(self, reports: list[Sent | None]) -> None:
        if errors := self.mark(reports):
            raise DeliveryError(f"{len(errors)} messages failed, the first: {errors[0]}")


class _Writer(DataSourceWriter):
    def __init__(self, writing: _Writing):
        self.writing = writing

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.writing.send(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.writing.finish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.writing.mark(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, writing: _Writing):
        self.writing = writing

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.writing.send(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.writing.finish(messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.writing.mark(messages)


class Messages(DataSource):
    """The format `messages`, for writing only."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(_Writing(self.options, schema.names))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(_Writing(self.options, schema.names))


def unsent(spark: SparkSession, rows: DataFrame, marks: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows whose key the folder of marks doesn't hold; all of them before the first message."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return rows
    kinds = dict(rows.dtypes)
    sent = spark.read.schema(", ".join(f"{k} string" for k in keys)).json(marks)
    return rows.join(sent.selectExpr(*(f"cast({k} as {kinds[k]}) as {k}" for k in keys)).distinct(), list(keys), "left_anti")
