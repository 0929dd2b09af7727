"""Batch enrichment with a pluggable model client.

``enrich`` is a ``mapInArrow`` step: each task builds its client once,
sends a bounded number of prompts of an Arrow batch at a time and returns the *key with the result*, so no
positional zip can misalign rows.  Retries, an optional in-task thread pool,
one rate limit for the job and the client's generation options are arguments.  Failures land in ``error`` and the
row is routed to rejects by :func:`split_parsed`; keys only enter a ledger
when their row parsed.
"""

from __future__ import annotations

import hashlib
import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.jsonx import parse_object_or_list
from corpusflow.functions.text import col_

PERSONA_ITEM = "struct<countries: array<string>, languages: array<string>, persona: string>"
PROMPT_ITEM = "struct<prompt: string, language: string>"
MOCK_MODEL = "mock-model"


def _last_user(messages) -> str:
    text = ""
    if messages is None:
        return text
    for m in messages:
        if m is not None and m.get("role") == "user":
            text = m.get("content") or ""
    return text


def mock_reply(content: str, kind: str = "persona") -> str:
    """Deterministic offline model: the reply is a function of md5(content).

    It answers 1-3 items; one reply in eight is wrapped in prose, one in eight
    is cut in half (malformed), one in eight is a bare JSON array.
    """
    h = hashlib.md5((content or "").encode("utf-8")).hexdigest()
    n = int(h[0:2], 16) % 3 + 1
    if kind == "persona":
        items = ['{"countries": ["C%s"], "languages": ["L%s"], "persona": "reader %s"}'
                 % (h[2 + i], h[5 + i], h[8 + 4 * i:12 + 4 * i]) for i in range(n)]
        body = '{"persona_list": [' + ", ".join(items) + "]}"
    else:
        items = ['{"prompt": "task %s", "language": "L%s"}' % (h[8 + 4 * i:12 + 4 * i], h[2 + i])
                 for i in range(n)]
        body = '{"prompts": [' + ", ".join(items) + "]}"
    mode = int(h[20], 16) % 8
    if mode == 0:
        return "Sure, here it is:\n" + body + "\nHope this helps."
    if mode == 1:
        return body[: len(body) // 2]
    if mode == 2:
        return "[" + ", ".join(items) + "]"
    return body


def mock_client(kind: str = "persona", **_options) -> Callable[[list], list]:
    """Client factory for :func:`enrich`: list of message lists -> list of (raw, model); options change nothing."""
    def call(prompts: list) -> list:
        return [(mock_reply(_last_user(p), kind), MOCK_MODEL) for p in prompts]
    return call


def with_retry(call: Callable[[list], list], attempts: int = 3, wait_s: float = 0.0) -> Callable[[list], list]:
    """Fixed-wait retry of a batch call; re-raises the last error."""
    def wrapped(prompts: list) -> list:
        last = None
        for i in range(attempts):
            try:
                return call(prompts)
            except Exception as e:  # noqa: BLE001 - any client failure is retried
                last = e
                if i + 1 < attempts and wait_s:
                    time.sleep(wait_s)
        raise last
    return wrapped


class RateLimiter:
    """E5: at most one call per interval inside one task; thread-safe.

    The interval is a number of seconds, or a function that gives the present one.
    """

    def __init__(self, interval: float | Callable[[], float] = 0.0):
        import threading
        self.interval = interval if callable(interval) else lambda: interval
        self._last = None
        self._lock = threading.Lock()

    def wait(self) -> None:
        with self._lock:
            gap = self.interval()
            if not gap:
                return
            if self._last is not None:
                left = gap - (time.monotonic() - self._last)
                while left > 0:
                    # A long wait is taken in parts: the interval may shrink when another task ends.
                    time.sleep(min(left, 0.25))
                    left = min(gap, self.interval()) - (time.monotonic() - self._last)
            self._last = time.monotonic()


class SharedRate:
    """One limit of calls a second for all tasks of a job, dealt anew among those that still run.

    A task that has ended leaves a marker in the shared folder.  Each of the
    others looks at the folder every ``check_s`` seconds and divides the limit by
    the tasks without a marker (also those that have not begun), so their
    shares never add up to more than the limit and none stays unused for long.
    A task that is run again takes its marker away first.
    """

    def __init__(self, folder: str, tasks: int, task: int, calls_per_s: float, check_s: float = 2.0):
        from pyarrow import fs
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.folder, self.tasks, self.task, self.calls_per_s, self.check_s = path, tasks, task, calls_per_s, check_s
        self._ended, self._looked = 0, -check_s
        if self.fs.get_file_info(self._mark()).type != fs.FileType.NotFound:
            self.fs.delete_file(self._mark())

    def _mark(self) -> str:
        return f"{self.folder}/ended-{self.task}"

    def interval(self) -> float:
        """Seconds between two calls of this task."""
        from pyarrow import fs
        if time.monotonic() - self._looked >= self.check_s:
            found = self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
            self._ended = sum(x.base_name.startswith("ended-") and x.base_name != f"ended-{self.task}" for x in found)
            self._looked = time.monotonic()
        return max(1, self.tasks - self._ended) / self.calls_per_s

    def end(self) -> None:
        """Give this task's share to the others."""
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(self._mark()) as f:
            f.write(b"")


def rate_folder(spark) -> str | None:
    """A fresh shared folder as a URI that Python workers can open; None if there is no client for its scheme."""
    from pyarrow import fs

    from corpusflow.session import new_scratch_dir
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_scratch_dir(spark, "rate"))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001 - any scheme or client that pyarrow does not have
        return None
    return uri


def answer(call: Callable[[list], list], prompts: list) -> list:
    """One (raw, model, error) per prompt.

    A call that fails, or answers with another number of results, is repeated
    prompt by prompt, so a single bad prompt fails alone.
    """
    try:
        got = list(call(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} results for {len(prompts)} prompts")
        return [(r, m, None) for r, m in got]
    except Exception as e:  # noqa: BLE001 - any client failure ends in the error column
        if len(prompts) == 1:
            return [(None, None, f"{type(e).__name__}: {e}")]
        return [x for p in prompts for x in answer(call, [p])]


def enrich(df: DataFrame, client_factory: Callable[..., Callable[[list], list]], prompt_col: str,
           key_cols: list[str], attempts: int = 3, wait_s: float = 0.0, batch_size: int = 64,
           concurrency: int = 1, calls_per_s: float | None = None, partitions: int | None = None,
           options: dict | None = None) -> DataFrame:
    """(keys..., raw STRING, model STRING, error STRING) per input row.

    ``client_factory(**options)`` is called once per task; ``options`` are the
    generation options of the client (temperature, maximum tokens, response
    schema, ...).  ``batch_size`` prompts go in one call; ``concurrency`` calls
    run at once inside a task (E4).  ``partitions`` sets the number of parallel
    clients by an exchange of the prompts; by default the input's own partitions
    are used.

    ``calls_per_s`` limits the whole job (E5): each of ``partitions`` tasks gets an
    equal share, so that together they never exceed it, however many run at
    once; the shares of tasks that have ended go to the others
    (:class:`SharedRate`, through the shared folder).
    """
    if calls_per_s and not partitions:
        raise ValueError("calls_per_s needs partitions: the limit is shared out among that many tasks")
    fixed = partitions / calls_per_s if calls_per_s else 0.0
    folder = rate_folder(df.sparkSession) if calls_per_s else None
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {key_types[k]}" for k in key_cols] + ["raw string", "model string", "error string"])
    inp = df.select(*key_cols, F.col(prompt_col).alias("_prompt"))
    if partitions:
        inp = inp.repartition(partitions)

    # So many prompts are Python objects at once, however many rows an Arrow batch has; the keys stay in Arrow.
    window = batch_size * max(1, concurrency) * 8

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext
        shared = SharedRate(folder, partitions, TaskContext.get().partitionId(), calls_per_s) if folder else None
        client, limiter = client_factory(**(options or {})), RateLimiter(shared.interval if shared else fixed)

        def limited(prompts: list) -> list:
            limiter.wait()
            return client(prompts)
        call = with_retry(limited, attempts, wait_s)
        pool = ThreadPoolExecutor(concurrency) if concurrency > 1 else None
        try:
            for batch in batches:
                keys = batch.select(key_cols)
                for at in range(0, batch.num_rows, window):
                    prompts = batch.column("_prompt").slice(at, window).to_pylist()
                    chunks = [prompts[i:i + batch_size] for i in range(0, len(prompts), batch_size)]
                    results = list(pool.map(lambda c: answer(call, c), chunks)) if pool else [answer(call, c) for c in chunks]
                    flat = [x for part in results for x in part]
                    replies = [pa.array([x[i] for x in flat], pa.string()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys.slice(at, window).columns, *replies], [*key_cols, "raw", "model", "error"])
            if shared:
                shared.end()
        finally:
            if pool:
                pool.shutdown()

    return inp.mapInArrow(run, schema)


def parsed_list(raw, list_field: str, item_schema: str) -> Column:
    """Items of ``{"<field>": [..]}`` or of a bare array in model text."""
    return parse_object_or_list(col_(raw), list_field, item_schema)


def split_parsed(df: DataFrame, items_col: str = "items", require: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects).  A row is rejected when it failed, did not parse,
    or any item misses a required field (all-or-nothing per source row)."""
    ok = F.col(items_col).isNotNull() & F.coalesce(F.col("error").isNull(), F.lit(True))
    if require:
        ok = ok & F.forall(F.col(items_col), lambda x: reduce(lambda a, b: a & b, [x[f].isNotNull() for f in require]))
    flag = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rejects = flag.where(~F.col("_ok")).withColumn(
        "reason", F.when(F.col("error").isNotNull(), F.lit("error"))
                   .when(F.col(items_col).isNull(), F.lit("unparsed"))
                   .otherwise(F.lit("invalid_item"))).drop("_ok")
    return flag.where(F.col("_ok")).drop("_ok"), rejects
