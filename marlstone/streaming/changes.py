"""The committed-change stream: batch reads, Structured Streaming, sinks and materialized workers.

Every commit leaves its changes in a folder of its own below ``feed/`` as (table, op, csn, old, new), the
rows as JSON.  The folder moves there once the commit is published, so a stream over ``feed/`` with
a checkpoint gives each committed change to an idempotent sink once, and nothing else; order within
a batch is by commit number.  A batch read takes its folders from the log: it reads only those of the
commits it is asked for.
"""

from __future__ import annotations

import json
import os
import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..database import Database

SCHEMA = "table string, op string, csn bigint, old string, new string"
#: Seconds between two looks for new commits.
LOOK_S = 0.05


def changes(db: Database, after: int = 0, upto: int | None = None, table: str | None = None) -> DataFrame:
    """Changes of the commits after < csn <= upto, of one table or of all; only published commits count."""
    paths = db.feed_paths(after, db.csn() if upto is None else upto)
    df = db.spark.read.schema(SCHEMA).parquet(*paths) if paths else db.spark.createDataFrame([], SCHEMA)
    return df.where(F.lower("table") == table.lower()) if table else df


def stream(db: Database, table: str | None = None) -> DataFrame:
    """The feed as a streaming DataFrame."""
    df = db.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(db.root, "feed"))
    return df.where(F.lower("table") == table.lower()) if table else df


def _in_order(df: DataFrame) -> DataFrame:
    """By commit number, which alone would put each commit's changes into one partition."""
    return df.orderBy("csn", F.xxhash64("old", "new"))


def _plain(r) -> dict:
    return r.asDict() | {k: json.loads(r[k]) if r[k] else None for k in ("old", "new")}


class ChangeStream:
    """A pull subscription from the commit at which it was made.

    Iterating over it waits for changes until it is closed.  Commits are read one after another, and
    a commit's changes come through an iterator, so a long backlog isn't held.
    """

    def __init__(self, db: Database, table: str | None = None, after: int | None = None):
        self.db, self.table = db, table
        self.cursor = db.csn() if after is None else after
        self._held: Iterator[dict] = iter(())
        self._closed = threading.Event()

    def poll(self) -> list[dict]:
        """Changes since the last call, in commit order."""
        top = self.db.csn()
        rows = changes(self.db, self.cursor, top, self.table).orderBy("csn").collect()
        self.cursor, held = top, list(self._held)
        return held + [_plain(r) for r in rows]

    drain = poll

    def try_recv(self) -> dict | None:
        """The next change if there is one."""
        while True:
            if (got := next(self._held, None)) is not None:
                return got
            if self._closed.is_set() or self.cursor >= self.db.csn():
                return None
            self.cursor += 1
            if self.db.feed_paths(self.cursor - 1, self.cursor):
                self._held = map(_plain, changes(self.db, self.cursor - 1, self.cursor, self.table).toLocalIterator())

    def recv(self, timeout: float | None = None) -> dict | None:
        """The next change, waiting for it; None once the stream is closed, TimeoutError after ``timeout`` seconds."""
        end = None if timeout is None else time.monotonic() + timeout
        while (got := self.try_recv()) is None:
            if self._closed.is_set():
                return None
            if end is not None and time.monotonic() >= end:
                raise TimeoutError("no change came")
            self._closed.wait(LOOK_S)
        return got

    def next_timeout(self, timeout: float) -> dict | None:
        """As ``recv``, but None when none came in time."""
        try:
            return self.recv(timeout)
        except TimeoutError:
            return None

    def close(self) -> None:
        """Ends the subscription; who waits on it gets None."""
        self._closed.set()

    def closed(self) -> bool:
        return self._closed.is_set()

    def wait(self, seconds: float) -> None:
        """Sleeps, but not beyond the end of the subscription."""
        self._closed.wait(seconds)

    def __iter__(self) -> Iterator[dict]:
        while (got := self.recv()) is not None:
            yield got

    def __enter__(self) -> ChangeStream:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Subscription:
    """Calls ``callback(old, new)`` for each change, in a thread of its own until it is closed.

    An error of the callback is printed and counted in ``errors``; the changes after it still come.
    """

    def __init__(self, stream: ChangeStream, callback: Callable[[dict | None, dict | None], object]):
        self.stream, self.callback, self.errors = stream, callback, 0
        #: The last commit whose changes were all handed over.
        self.seen = stream.cursor
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self.stream.closed():
            while (got := self.stream.try_recv()) is not None:
                try:
                    self.callback(got["old"], got["new"])
                except Exception:  # noqa: BLE001
                    self.errors += 1
                    traceback.print_exc()
            self.seen = self.stream.cursor
            self.stream.wait(LOOK_S)

    def is_running(self) -> bool:
        return self._thread.is_alive()

    def settle(self, timeout: float = 60.0) -> None:
        """Waits until every commit so far was handed over."""
        want, end = self.stream.db.csn(), time.monotonic() + timeout
        while self.seen < want and self.is_running():
            if time.monotonic() > end:
                raise TimeoutError("changes are still being handed over")
            time.sleep(LOOK_S)

    def close(self) -> None:
        self.stream.close()
        if self._thread is not threading.current_thread():
            self._thread.join()

    def __enter__(self) -> Subscription:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def on_change(db: Database, table: str | None, callback: Callable[[dict | None, dict | None], object], after: int | None = None) -> Subscription:
    """Calls ``callback(old, new)`` for each committed change of a table (or of all) from now on, or from a commit on."""
    return Subscription(ChangeStream(db, table, after), callback)


def wire_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each change as a JSON line with table, op, csn, old and new."""
    row = lambda c: F.coalesce(F.col(c), F.lit("null"))
    q = lambda c: F.to_json(F.array(F.col(c)))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    df = df.withColumn("_t", q("table")).withColumn("_o", q("op"))
    return df.select(F.concat(F.lit('{"table":'), inner("_t"), F.lit(',"op":'), inner("_o"), F.lit(',"csn":'), F.col("csn").cast("string"), F.lit(',"old":'), row("old"), F.lit(',"new":'), row("new"), F.lit("}")).alias("value"))


def jsonl_sink(db: Database, target: str, checkpoint: str, table: str | None = None):
    """A started query that writes the feed as JSON lines, one folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        wire_json(_in_order(batch)).write.mode("overwrite").text(os.path.join(target, f"batch={number:09d}"))

    return stream(db, table).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Worker:
    """Materialized state: subclass with ``apply(change)`` for each change, ``on_commit(csn)`` after each commit, and
    ``on_pass(csn)`` for what looks at everything, after every so many commits (see ``Materialized``)."""

    def apply(self, change: dict) -> None:
        raise NotImplementedError

    def on_commit(self, csn: int) -> None:
        pass

    def on_pass(self, csn: int) -> None:
        pass


class FrameWorker(Worker):
    """State too large for one process: ``apply_commit`` gets a commit's changes as a DataFrame, to keep its state in tables."""

    def apply_commit(self, csn: int, changes: DataFrame) -> None:
        raise NotImplementedError


class Materialized:
    """A worker fed by a streaming query; batches seen before are skipped by the commit number."""

    def __init__(self, db: Database, name: str, worker: Worker, table: str | None = None, after: int = 0, checkpoint: str | None = None, follow: bool = True, pass_every: int = 0):
        self.commits, self.pass_every = 0, pass_every
        self.name, self.worker, self.cursor = name, worker, after
        self._lock = threading.RLock()
        self._db = db
        at = checkpoint or os.path.join(db.root, "workers", f"{name}-{uuid.uuid4().hex}")
        # a stream's name is for the whole session
        writer = stream(db, table).writeStream.queryName(f"{name}-{uuid.uuid4().hex[:8]}").option("checkpointLocation", at).foreachBatch(self._batch)
        self.stream = (writer.trigger(processingTime="200 milliseconds") if follow else writer.trigger(availableNow=True)).start()

    def _batch(self, batch: DataFrame, _number: int) -> None:
        # the worker's state is in this process; rows come a partition at a time
        batch = batch.where(F.col("csn") > self.cursor)
        if isinstance(self.worker, FrameWorker):
            with self._lock:
                self._frames(batch)
            return
        rows = _in_order(batch).toLocalIterator()
        with self._lock:
            last = None
            for r in rows:
                if last is not None and r["csn"] != last:
                    self._done(last)
                self.worker.apply(_plain(r))
                last = r["csn"]
            if last is not None:
                self._done(last)
                self.cursor = last

    def _frames(self, batch: DataFrame) -> None:
        for r in batch.select("csn").distinct().orderBy("csn").collect():
            self.worker.apply_commit(r["csn"], batch.where(F.col("csn") == r["csn"]))
            self._done(r["csn"])
            self.cursor = r["csn"]

    def _done(self, csn: int) -> None:
        self.worker.on_commit(csn)
        self.commits += 1
        if self.pass_every and self.commits % self.pass_every == 0:
            self.worker.on_pass(csn)

    def query(self, fn: Callable[[Worker], object]) -> object:
        with self._lock:
            return fn(self.worker)

    update = query

    def is_running(self) -> bool:
        return self.stream.isActive

    def settle(self) -> None:
        """Waits until every commit so far has been applied."""
        if self.stream.isActive:
            self.stream.processAllAvailable()

    def stop(self) -> None:
        self.stream.stop()


class Workers:
    """Named workers of a database."""

    def __init__(self, db: Database):
        self.db, self.running = db, {}

    def register(self, name: str, worker: Worker, table: str | None = None, **how) -> Materialized:
        if name in self.running and self.running[name].is_running():
            raise ValueError(f"worker {name} is running")
        self.running[name] = Materialized(self.db, name, worker, table, **how)
        return self.running[name]

    def workers(self) -> list[str]:
        return sorted(n for n, w in self.running.items() if w.is_running())

    def worker(self, name: str) -> Materialized | None:
        return self.running.get(name)

    def stop_worker(self, name: str) -> bool:
        w = self.running.pop(name, None)
        if w:
            w.stop()
        return w is not None
