"""SNK-5: deliver records to an HTTP endpoint from the executors.

A Python data source (``format("changeflow_http")``) whose writer posts each
task's rows in batches; rows reach Python as Arrow record batches, not one
by one. The transport is injectable by option, as
``module:function`` taking (url, list_of_records) and returning nothing or
raising; the default posts a JSON array with urllib. Failed posts are retried
with backoff; a batch that still fails fails the task (Spark retries it), so
delivery is at least once and consumers deduplicate (DER-4).
"""

from __future__ import annotations

import importlib
import json
import time
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)


def post_json(url: str, records: list[dict], timeout: float = 30.0) -> None:
    """Default transport: one POST of a JSON array (30 s timeout)."""
    import urllib.request

    body = json.dumps(records, default=str).encode("utf-8")
    req = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(req, timeout=timeout) as resp:
        if resp.status >= 300:
            raise IOError(f"HTTP {resp.status} from {url}")


def file_transport(url: str, records: list[dict]) -> None:
    """Offline transport: each batch becomes one JSON file in the folder ``file://...``.

    Useful where no endpoint may be reached (tests, dry runs); file names are
    unique per batch, so retried batches show up as repeats, as they would at
    an HTTP receiver.
    """
    import os
    import uuid

    folder = url[len("file://"):] if url.startswith("file://") else url
    with open(os.path.join(folder, f"batch-{uuid.uuid4().hex}.json"), "w") as f:
        json.dump(records, f, default=str)


def _resolve(spec: str | None):
    if not spec:
        return post_json
    module, _, fn = spec.partition(":")
    return getattr(importlib.import_module(module), fn)


@dataclass
class _Sent(WriterCommitMessage):
    rows: int
    batches: int


class _HttpWriterBase:
    def __init__(self, options: dict):
        self.url = options.get("url", "")
        self.batch_size = int(options.get("batchSize", "500"))
        self.retries = int(options.get("retries", "3"))
        self.backoff = float(options.get("backoffSeconds", "1.0"))
        self.transport_spec = options.get("transport")

    def _send(self, transport, batch: list[dict]) -> None:
        for attempt in range(self.retries + 1):
            try:
                transport(self.url, batch)
                return
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.backoff * (2**attempt))

    def write(self, iterator):
        """Rows arrive as Arrow record batches; each is cut into posts of ``batchSize``."""
        transport = _resolve(self.transport_spec)
        rows, batches = 0, 0
        for record_batch in iterator:
            for start in range(0, record_batch.num_rows, self.batch_size):
                chunk = record_batch.slice(start, self.batch_size).to_pylist()
                self._send(transport, chunk)
                rows, batches = rows + len(chunk), batches + 1
        return _Sent(rows, batches)


class HttpBatchWriter(_HttpWriterBase, DataSourceArrowWriter):
    pass


class HttpStreamWriter(_HttpWriterBase, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId) -> None:  # delivery happened in the tasks
        pass

    def abort(self, messages, batchId) -> None:
        pass


class HttpSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changeflow_http"

    def writer(self, schema, overwrite: bool):
        return HttpBatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool):
        return HttpStreamWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(HttpSink)
