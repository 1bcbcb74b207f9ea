"""Versioned tables as immutable Parquet parts under one commit log.

``log/<csn>.json`` lists what each commit did; it is created exclusively, so a commit is visible as
a whole or not at all, and one sequence of numbers orders the commits of all tables.  A part holds
full rows with the number of the commit that wrote them and an operation: I, U or D.  A snapshot at a
number is, for each key, the latest version up to it that isn't a deletion: rows of parts that only
inserted are scanned as they are, without those that a later part changed; keys and filters on them
reach both scans.

A commit's changes are written apart before it and move into ``feed/`` after it, so the feed holds
changes of published commits only; if the writer dies in between, the next one moves them.

Writers take turns through a lock file, on a file system with POSIX locks; readers never wait.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil
import time
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DuplicateKey, KeyNotFound, SchemaMismatch, TableExists, TableNotFound, WriteConflict
from .session import metadata_reads
from .spec import TableSpec, coerced, parse_create

#: Parts of a table beyond which compaction is due, or this share of its versions being outdated.
PARTS_DUE, DEAD_DUE = 8, 0.10
#: Commits after the last checkpoint from which on another is due.
CHECKPOINT_DUE = 64
#: Changed keys, by the log's counts, up to which they are broadcast to the scan of the unchanged rows.
BROADCAST_KEYS = 500_000
#: Staged rows of a transaction are taken for abandoned after so many seconds.
STAGED_S = 86_400
#: When a commit is on disk: before it returns, with the next flush that is due within GROUP_S, or with the next flush.
DURABILITY, GROUP_S = ("sync", "group", "async"), 0.05


class Database:
    """A directory of tables."""

    def __init__(self, spark: SparkSession, root: str, durability: str = "sync"):
        if durability not in DURABILITY:
            raise ValueError(f"durability is one of {DURABILITY}")
        self.spark, self.root, self.durability = spark, os.path.abspath(root), durability
        for d in ("log", "data", "feed", "pending"):
            os.makedirs(os.path.join(self.root, d), exist_ok=True)
        self._pins: dict[int, int] = {}
        #: Commits after the checkpoint that this process starts from.
        self._log: list[dict] = []
        self._base, state = self._last_checkpoint()
        #: Tables as of some commits: the checkpoint, and the last ones asked for.
        self._folds: dict[int, dict[str, dict]] = {self._base: state}
        self._unsynced: list[str] = []
        self._synced_at = time.monotonic()
        #: What this process did.
        self.metrics: Counter[str] = Counter()

    # the log
    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _entry(self, csn: int) -> dict:
        with open(self._path("log", f"{csn:012d}.json")) as f:
            return json.load(f)

    def entries(self, after: int = 0, upto: int | None = None) -> list[dict]:
        """Commits after < csn <= upto (or all), in order and without a gap."""
        n = self._base + len(self._log)
        while os.path.exists(self._path("log", f"{n + 1:012d}.json")):
            n += 1
            self._log.append(self._entry(n))
        upto = n if upto is None else min(upto, n)
        old = [self._entry(i) for i in range(after + 1, min(self._base, upto) + 1)]
        return old + self._log[max(after - self._base, 0) : max(upto - self._base, 0)]

    def csn(self) -> int:
        self.entries(self._base + len(self._log))
        return self._base + len(self._log)

    def _last_checkpoint(self) -> tuple[int, dict[str, dict]]:
        found = sorted(f for f in os.listdir(self._path("log")) if f.startswith("checkpoint-"))
        if not found:
            return 0, {}
        with open(self._path("log", found[-1])) as f:
            got = json.load(f)
        return got["csn"], {n: t | {"spec": TableSpec.from_json(t["spec"])} for n, t in got["tables"].items()}

    def checkpoint(self) -> int:
        """Writes all tables' state as of now, from which databases are opened without replaying the log."""
        csn = self.csn()
        staged = self._path("log", f".{uuid.uuid4().hex}")
        with open(staged, "w") as f:
            json.dump({"csn": csn, "tables": {n: t | {"spec": t["spec"].to_json()} for n, t in self.tables(csn).items()}}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, self._path("log", f"checkpoint-{csn:012d}.json"))
        self.metrics["checkpoints"] += 1
        return csn

    def checkpoint_due(self) -> bool:
        return self.csn() - self._last_checkpoint()[0] >= CHECKPOINT_DUE

    @contextlib.contextmanager
    def _turn(self) -> Iterator[None]:
        with open(self._path("lock"), "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _publish(self, ops: list[dict]) -> int:
        csn = self.csn() + 1
        staged = self._path("log", f".{uuid.uuid4().hex}")
        with open(staged, "w") as f:
            json.dump({"csn": csn, "ops": ops}, f)
            f.flush()
            if self.durability == "sync":
                os.fsync(f.fileno())
        os.link(staged, path := self._path("log", f"{csn:012d}.json"))  # fails if it is there
        os.unlink(staged)
        self.metrics["commits"] += 1
        self.metrics["rows"] += sum(op.get("rows", 0) for op in ops)
        if self.durability != "sync":
            self._unsynced.append(path)
            if self.durability == "group" and time.monotonic() - self._synced_at >= GROUP_S:
                self.flush()
        return csn

    def flush(self) -> int:
        """Commits of this process that are on disk only now."""
        done, self._unsynced = self._unsynced, []
        for path in done:
            with open(path) as f:
                os.fsync(f.fileno())
        self._synced_at = time.monotonic()
        self.metrics["flushes"] += bool(done)
        return len(done)

    def _settle_feed(self) -> None:
        """Moves published changes into the feed that aren't there yet; called in turn."""
        now = self.csn()
        for name in sorted(os.listdir(self._path("pending"))):
            csn = int(name.split("-")[0])
            if csn <= now and any(op.get("feed") == name for op in self._entry(csn)["ops"]):
                os.rename(self._path("pending", name), self._path("feed", name))

    def feed_paths(self, after: int, upto: int) -> list[str]:
        """Where the changes of these commits are."""
        found = []
        for e in self.entries(after, upto):
            for op in e["ops"]:
                if op.get("feed"):
                    at = self._path("feed", op["feed"])
                    found.append(at if os.path.exists(at) else self._path("pending", op["feed"]))
        return found

    # the catalog
    def tables(self, csn: int | None = None) -> dict[str, dict]:
        """Name in lower case -> {spec, id, parts, pure} as of csn; not to be changed."""
        at = self.csn() if csn is None else min(csn, self.csn())
        if at in self._folds:
            return self._folds[at]
        base = max((c for c in self._folds if c <= at), default=0)
        found = {n: t | {"parts": list(t["parts"])} for n, t in self._folds.get(base, {}).items()}
        for e in self.entries(base, at):
            for op in e["ops"]:
                name = op["table"].lower()
                if op["kind"] == "create":
                    found[name] = {"spec": TableSpec.from_json(op["spec"]), "id": op["id"], "parts": [], "pure": True, "next_rowid": 1}
                elif op["kind"] == "drop":
                    del found[name]
                elif op["kind"] == "truncate":
                    found[name] |= {"id": op["id"], "parts": [], "pure": True, "next_rowid": 1}
                elif op["kind"] == "compact":
                    t = found[name]
                    newer = [p for p in t["parts"] if p["csn"] > op["upto"]]
                    t |= {"parts": [{"path": op["path"], "csn": op["upto"], "rows": op["rows"], "pure": True}, *newer]}
                    t["pure"] = all(p["pure"] for p in t["parts"])
                else:
                    t = found[name]
                    t["parts"].append({"path": op["path"], "csn": e["csn"], "rows": op["rows"], "pure": op["pure"]})
                    t["pure"] &= op["pure"]
                    t["next_rowid"] = max(t["next_rowid"], op.get("next_rowid", 1))
        while len(self._folds) >= 16:
            del self._folds[next(c for c in self._folds if c != self._base)]
        self._folds[at] = found
        return found

    def _table(self, name: str, csn: int | None = None) -> dict:
        t = self.tables(csn).get(name.lower())
        if t is None:
            raise TableNotFound(f"no table {name}")
        return t

    def spec(self, name: str) -> TableSpec:
        return self._table(name)["spec"]

    def table_names(self) -> list[str]:
        return sorted(t["spec"].name for t in self.tables().values())

    def create(self, spec: TableSpec | str) -> None:
        spec = parse_create(spec) if isinstance(spec, str) else spec
        with self._turn():
            if spec.name.lower() in self.tables():
                raise TableExists(f"table {spec.name} exists")
            self._publish([{"kind": "create", "table": spec.name, "spec": spec.to_json(), "id": uuid.uuid4().hex}])

    def table_or_create(self, spec: TableSpec | str) -> TableSpec:
        spec = parse_create(spec) if isinstance(spec, str) else spec
        with contextlib.suppress(TableExists):
            self.create(spec)
        return self.spec(spec.name)

    def drop(self, name: str) -> None:
        with self._turn():
            self._table(name)
            self._publish([{"kind": "drop", "table": name}])

    def truncate(self, name: str) -> None:
        """Empties the table as a new incarnation; no change is published."""
        with self._turn():
            self._table(name)
            self._publish([{"kind": "truncate", "table": name, "id": uuid.uuid4().hex}])

    # reading
    def _versions(self, t: dict, pure: bool | None = None) -> DataFrame:
        """The rows of the table's parts, of those that only inserted or of the others."""
        meta = ", _csn bigint, _op string"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t["spec"].schema(hidden=True)) + meta
        paths = [self._path(p["path"]) for p in t["parts"] if pure is None or p["pure"] == pure]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, t: dict, csn: bool = False) -> DataFrame:
        """The live rows, with the commit that wrote each if ``csn``."""
        spec: TableSpec = t["spec"]
        names = [*spec.names(hidden=True), *(["_csn"] if csn else [])]
        cols = [F.col(f"`{n}`") for n in names]
        if t["pure"]:
            return self._versions(t).select(*cols)
        # the key comes from the grouping, so that filters on it go below
        rest = [F.col(f"`{n}`") for n in names if n not in (spec.key, "_csn")]
        key = F.col(f"`{spec.key}`")
        latest = self._versions(t, False).groupBy(key).agg(F.max("_csn").alias("_csn"), F.max_by(F.struct(*rest, "_op"), "_csn").alias("_v"))
        value = [F.col(f"`{n}`") if n in (spec.key, "_csn") else F.col(f"_v.`{n}`").alias(n) for n in names]
        changed = latest.select(key.alias("_k"), F.col("_csn").alias("_c"))
        if sum(p["rows"] for p in t["parts"] if not p["pure"]) <= BROADCAST_KEYS:
            changed = F.broadcast(changed)
        same = self._versions(t, True).join(changed, (key == F.col("_k")) & (F.col("_csn") < F.col("_c")), "left_anti")
        return same.select(*cols).unionAll(latest.where("_v._op <> 'D'").select(*value))

    def table(self, name: str, csn: int | None = None, hidden: bool = False) -> DataFrame:
        """The table as of a commit number (now, without one)."""
        t = self._table(name, csn)
        self.metrics["snapshots"] += 1
        return self._live(t).select(*(F.col(f"`{n}`") for n in t["spec"].names(hidden)))

    def metadata(self, name: str, csn: int | None = None) -> DataFrame | None:
        """The table read so that bare COUNT, MIN and MAX come from the files' footers; None once rows were changed."""
        t = self._table(name, csn)
        if not t["pure"] or not t["parts"]:
            return None
        return metadata_reads(self.spark, *(self._path(p["path"]) for p in t["parts"])).select(*(F.col(f"`{n}`") for n in t["spec"].names()))

    def get(self, name: str, key, csn: int | None = None):
        """The row of a key or None; the filter reaches the Parquet scan."""
        t = self._table(name, csn)
        spec = t["spec"]
        narrowed = self._versions(t).where(F.col(f"`{spec.key}`") == F.lit(key))
        rows = sorted(narrowed.collect(), key=lambda r: r["_csn"])
        return None if not rows or rows[-1]["_op"] == "D" else type(rows[-1])(**{n: rows[-1][n] for n in spec.names()})

    def scan_key_range(self, name: str, lo, hi, csn: int | None = None) -> DataFrame:
        """Rows with lo <= key < hi; either end may be None."""
        df, k = self.table(name, csn), F.col(f"`{self._table(name, csn)['spec'].key}`")
        if lo is not None:
            df = df.where(k >= F.lit(lo))
        return df if hi is None else df.where(k < F.lit(hi))

    @contextlib.contextmanager
    def pin(self, csn: int | None = None) -> Iterator[int]:
        """Holds a snapshot: vacuum keeps what it needs."""
        at = self.csn() if csn is None else csn
        self._pins[at] = self._pins.get(at, 0) + 1
        try:
            yield at
        finally:
            self._pins[at] -= 1
            if not self._pins[at]:
                del self._pins[at]

    def horizon(self) -> int:
        """The oldest commit that a pin needs."""
        return min(self._pins, default=self.csn())

    # writing: a change is (all columns, _op) with full rows; deletions carry the old row
    def commit(self, changes: list[tuple[str, DataFrame | str, bool]], since: int | None = None) -> int:
        """Publishes changes of several tables as one commit.

        changes: (table, rows with columns + _op + _old JSON of the row before, or where such rows are staged, pure inserts).
        ``since``: the commit that a transaction read; keys committed after it conflict.
        """
        staged = [(n, df if isinstance(df, str) else self._stage(df), pure) for n, df, pure in changes]
        try:
            return self._commit(staged, since)
        finally:
            for _, path, _ in staged:
                self._unstage(path)

    def _commit(self, staged: list[tuple[str, str, bool]], since: int | None) -> int:
        with self._turn():
            if since is not None:
                for name, path, _pure in staged:
                    self._conflicts(name, path, since)
            self._settle_feed()
            csn, ops = self.csn() + 1, []
            for name, path, pure in staged:
                t = self._table(name)
                spec = t["spec"]
                df = self.spark.read.parquet(self._path(path))
                op = {"kind": "write", "table": spec.name, "pure": pure}
                if pure:
                    self._no_duplicates(t, df, staged=True)
                data = f"data/{t['id']}-{csn:012d}-{uuid.uuid4().hex[:8]}"
                cols = [F.col(f"`{n}`") for n in spec.names(hidden=True)]
                df.select(*cols, F.lit(csn).cast("long").alias("_csn"), "_op").sortWithinPartitions(F.col(f"`{spec.key}`")).write.parquet(self._path(data))
                got = self.spark.read.parquet(self._path(data)).agg(F.count("*").alias("n"), (F.max("_rowid") if spec.keyless else F.lit(0)).alias("r")).first()
                ops.append(op | {"path": data, "rows": got["n"], "next_rowid": int(got["r"] or 0) + 1})
                new = F.when(F.col("_op") != "D", F.to_json(F.struct(*(F.col(f"`{n}`") for n in spec.names())), {"ignoreNullFields": "false"}))
                names = {"I": "insert", "U": "update", "D": "delete"}
                kind = F.coalesce(*(F.when(F.col("_op") == a, F.lit(b)) for a, b in names.items()))
                feed = df.select(F.lit(spec.name).alias("table"), kind.alias("op"), F.lit(csn).cast("long").alias("csn"), F.col("_old").alias("old"), new.alias("new"))
                ops[-1]["feed"] = f"{csn:012d}-{uuid.uuid4().hex}"
                feed.write.parquet(self._path("pending", ops[-1]["feed"]))
            done = self._publish(ops)
            self._settle_feed()
        return done

    def _stage(self, df: DataFrame) -> str:
        path = f"data/staged-{uuid.uuid4().hex}"
        df.write.parquet(self._path(path))
        return path

    def _unstage(self, path: str) -> None:
        shutil.rmtree(self._path(path), ignore_errors=True)

    def _conflicts(self, name: str, path: str, since: int) -> None:
        t = self._table(name)
        if t["spec"].keyless:
            return
        # what the commits since then wrote, not what a compaction moved
        newer = [op["path"] for e in self.entries(since) for op in e["ops"] if op["kind"] == "write" and op["path"].startswith(f"data/{t['id']}-")]
        if newer:
            k = F.col(f"`{t['spec'].key}`").alias("k")
            theirs = self.spark.read.parquet(*map(self._path, newer)).select(k)
            hit = self.spark.read.parquet(self._path(path)).select(k).join(theirs, "k", "left_semi").first()
            if hit:
                self.metrics["conflicts"] += 1
                raise WriteConflict(f"{name}: key {hit[0]!r} was committed by another transaction")

    def _no_duplicates(self, t: dict, rows: DataFrame, staged: bool = False) -> None:
        spec = t["spec"]
        if spec.keyless:
            return
        k = F.col(f"`{spec.key}`").alias("k")
        twice = rows.groupBy(k).count().where("count > 1").first()
        taken = twice or (rows.select(k).join(self._live(t).select(k), "k", "left_semi").first() if t["parts"] else None)
        if taken:
            raise DuplicateKey(f"{spec.name}: key {taken[0]!r} exists")

    def _numbered(self, t: dict, rows: DataFrame, base: int | None = None) -> DataFrame:
        if not t["spec"].keyless:
            return rows
        return rows.withColumn("_rowid", F.monotonically_increasing_id() + F.lit(base or t["next_rowid"]))

    def inserts(self, name: str, rows: DataFrame, base_rowid: int | None = None, checked: bool = True) -> DataFrame:
        """Changes for new rows, validated unless that comes later."""
        t = self._table(name)
        spec = t["spec"]
        if {c.lower() for c in rows.columns} != {c.lower() for c in spec.names()}:
            raise SchemaMismatch(f"{name} has columns {spec.names()}")
        rows = coerced(rows, spec)
        if checked:
            spec.validate(rows)
        return self._numbered(t, rows, base_rowid).withColumn("_op", F.lit("I")).withColumn("_old", F.lit(None).cast("string"))

    def insert(self, name: str, rows: DataFrame) -> int:
        """New rows in one commit; a key that exists or occurs twice is an error and nothing is written."""
        return self.commit([(name, self.inserts(name, rows), True)])

    def bulk_load(self, name: str, rows: DataFrame) -> int:
        """As insert, for many rows: they are written once, spread by ranges of the key, and checked where they lie."""
        with self._turn():
            self._settle_feed()
            t, csn = self._table(name), self.csn() + 1
            spec = t["spec"]
            data = f"data/{t['id']}-{csn:012d}-{uuid.uuid4().hex[:8]}"
            key = F.col(f"`{spec.key}`")
            df = self.inserts(name, rows, checked=False).select(*(F.col(f"`{n}`") for n in spec.names(hidden=True)), F.lit(csn).cast("long").alias("_csn"), "_op")
            try:
                (df if spec.keyless else df.repartitionByRange(key)).sortWithinPartitions(key).write.parquet(self._path(data))
                back = self.spark.read.schema(df.schema).parquet(self._path(data))
                spec.validate(back)
                self._no_duplicates(t, back)
                got = back.agg(F.count("*").alias("n"), (F.max("_rowid") if spec.keyless else F.lit(0)).alias("r")).first()
                op = {"kind": "write", "table": spec.name, "pure": True, "path": data, "rows": got["n"], "next_rowid": int(got["r"] or 0) + 1, "feed": f"{csn:012d}-{uuid.uuid4().hex}"}
                new = back.select(F.lit(spec.name).alias("table"), F.lit("insert").alias("op"), F.lit(csn).cast("long").alias("csn"), F.lit(None).cast("string").alias("old"), _json(spec).alias("new"))
                new.write.parquet(self._path("pending", op["feed"]))
                self._publish([op])
            except BaseException:
                shutil.rmtree(self._path(data), ignore_errors=True)
                raise
            self._settle_feed()
        return csn

    def upserts(self, name: str, rows: DataFrame, current: DataFrame | None = None) -> DataFrame:
        t = self._table(name)
        spec = t["spec"]
        rows = coerced(rows, spec)
        spec.validate(rows)
        now = self._live(t) if current is None else current
        old = now.select(F.col(f"`{spec.key}`").alias("_k"), _json(spec).alias("_old"))
        joined = rows.join(old, F.col(f"`{spec.key}`") == F.col("_k"), "left")
        return joined.select(*(F.col(f"`{n}`") for n in spec.names()), F.when(F.col("_old").isNull(), "I").otherwise("U").alias("_op"), "_old")

    def upsert(self, name: str, rows: DataFrame) -> int:
        """New or replacing rows by key; of rows that share a key any one."""
        spec = self.spec(name)
        if spec.keyless:
            return self.insert(name, rows)
        return self.commit([(name, self.upserts(name, rows).dropDuplicates([spec.key]), False)])

    def update(self, name: str, rows: DataFrame) -> int:
        """Replacing rows by key; a key that isn't there is an error."""
        changes = self.upserts(name, rows)
        gone = changes.where("_op = 'I'").first()
        if gone:
            raise KeyNotFound(f"{name}: no key {gone[self.spec(name).key]!r}")
        return self.commit([(name, changes, False)])

    def deletes(self, name: str, rows: DataFrame) -> DataFrame:
        """Changes that delete live rows (with all columns, the hidden one too)."""
        spec = self.spec(name)
        return rows.select(*(F.col(f"`{n}`") for n in spec.names(hidden=True)), F.lit("D").alias("_op"), _json(spec).alias("_old"))

    def delete(self, name: str, keys: list) -> int:
        """Deletes by key; a key that isn't there is an error."""
        t = self._table(name)
        k = F.col(f"`{t['spec'].key}`")
        hit = self._live(t).where(k.isin(*keys) if keys else F.lit(False))
        found = {r[0] for r in hit.select(k).collect()}
        if missing := [x for x in keys if x not in found]:
            raise KeyNotFound(f"{name}: no key {missing[0]!r}")
        return self.commit([(name, self.deletes(name, hit), False)])

    # upkeep
    def stats(self) -> DataFrame:
        """(table, parts, versions, bytes, compaction_due) from the log and the files' sizes."""
        rows = []
        for t in self.tables().values():
            size = sum(os.path.getsize(os.path.join(d, f)) for p in t["parts"] for d, _, fs in os.walk(self._path(p["path"])) for f in fs)
            rows.append((t["spec"].name, len(t["parts"]), sum(p["rows"] for p in t["parts"]), size, len(t["parts"]) >= PARTS_DUE))
        return self.spark.createDataFrame(rows, "table string, parts long, versions long, bytes long, compaction_due boolean")

    def compact(self, name: str) -> bool:
        """Rewrites the live rows as one sorted part, each with the commit that wrote it; earlier snapshots keep theirs until vacuum."""
        t, upto = self._table(name), self.csn()
        if not t["parts"]:
            return False
        path = f"data/{t['id']}-base-{uuid.uuid4().hex[:8]}"
        live = self._live(t, csn=True).withColumn("_op", F.lit("I"))
        live.repartitionByRange(F.col(f"`{t['spec'].key}`")).sortWithinPartitions(F.col(f"`{t['spec'].key}`")).write.parquet(self._path(path))
        rows = self.spark.read.parquet(self._path(path)).count()
        with self._turn():
            if self._table(name)["id"] != t["id"]:
                shutil.rmtree(self._path(path))
                return False
            self._publish([{"kind": "compact", "table": t["spec"].name, "path": path, "upto": upto, "rows": rows}])
        self.metrics["compactions"] += 1
        return True

    def compact_all(self) -> list[str]:
        """Compacts the tables for which it is due."""
        return [n for n in self.table_names() if self.compaction_due(n) and self.compact(n)]

    def compaction_due(self, name: str) -> bool:
        t = self._table(name)
        versions = sum(p["rows"] for p in t["parts"])
        return len(t["parts"]) >= PARTS_DUE or (not t["pure"] and versions > 0 and 1 - self._live(t).count() / versions >= DEAD_DUE)

    def vacuum(self) -> int:
        """Deletes parts that neither now nor any pinned snapshot reads; the number of parts deleted."""
        with self._turn():
            used = {p["path"] for c in (self.horizon(), *self._pins, self.csn()) for t in self.tables(c).values() for p in t["parts"]}
            # what commits after a pin wrote decides whether its transaction conflicts
            used |= {op["path"] for e in self.entries(self.horizon()) for op in e["ops"] if "path" in op}
            old = time.time() - STAGED_S
            held = lambda d: d.startswith("staged-") and os.path.getmtime(self._path("data", d)) > old
            gone = [d for d in os.listdir(self._path("data")) if f"data/{d}" not in used and not held(d)]
            for d in gone:
                shutil.rmtree(self._path("data", d), ignore_errors=True)
            self._settle_feed()
            for d in os.listdir(self._path("pending")):  # changes of commits that never were
                shutil.rmtree(self._path("pending", d), ignore_errors=True)
        self.metrics["vacuumed"] += len(gone)
        return len(gone)

    def backup(self, target: str) -> None:
        """A copy of the log, the parts it needs and the feed, taken between commits."""
        with self._turn():
            self._settle_feed()
            os.makedirs(os.path.join(target, "data"))
            shutil.copytree(self._path("log"), os.path.join(target, "log"))
            shutil.copytree(self._path("feed"), os.path.join(target, "feed"))
            for t in self.tables().values():
                for p in t["parts"]:
                    shutil.copytree(self._path(p["path"]), os.path.join(target, p["path"]))

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, root: str) -> Database:
        shutil.copytree(backup, root)
        return cls(spark, root)


def _json(spec: TableSpec):
    return F.to_json(F.struct(*(F.col(f"`{n}`") for n in spec.names())), {"ignoreNullFields": "false"})
