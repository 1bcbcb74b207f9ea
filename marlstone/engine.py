"""The SQL facade: definitions, changes and transactions here; every query goes to Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .errors import DataError, OperationalError, SqlError
from .rewrite import rewritten
from .sources.copyin import parse_copy, read_delimited
from .spec import TableSpec, parse_create, split_top, tokens, unquoted

_QUERY = re.compile(r"(?is)^\s*[(\s]*(SELECT|WITH|VALUES|SHOW|DESCRIBE|EXPLAIN|TABLE|FROM)\b")


#: A query of nothing but COUNT, MIN and MAX of columns of one table.
_BARE = re.compile(r"(?is)^\s*SELECT\s+(?:(?:COUNT\s*\(\s*\*\s*\)|(?:COUNT|MIN|MAX)\s*\(\s*[\w\"`]+\s*\))(?:\s+(?:AS\s+)?[\w\"`]+)?\s*(?:,\s*(?!FROM\b)|(?=\s*FROM\b)))+\s*FROM\s+(?P<table>[\w\"`]+)\s*;?\s*$")


class Engine:
    """One session on a database: autocommit unless BEGIN opened a transaction."""

    def __init__(self, spark: SparkSession, root: str | Database):
        self.spark = spark
        self.db = root if isinstance(root, Database) else Database(spark, root)
        self.txn: Transaction | None = None
        #: Rows that the last change touched, -1 after a query.
        self.affected = -1

    # names
    def _view(self, name: str) -> DataFrame:
        return self.txn.table(name) if self.txn else self.db.table(name)

    def _hidden(self, name: str) -> DataFrame:
        return self.txn.table(name, hidden=True) if self.txn else self.db.table(name, hidden=True)

    def _register(self, sql: str, csn: int | None = None) -> None:
        """The tables that a query names, as views of one snapshot."""
        words = {unquoted(t).lower() for t, _, _ in tokens(sql)}
        at = csn if csn is not None else self.txn.csn if self.txn else self.db.csn()
        for name, t in self.db.tables(at).items():
            if name in words:
                (self._view(name) if csn is None else self.db.table(name, csn)).createOrReplaceTempView(t["spec"].name)

    def query(self, sql: str, args: list | None = None, csn: int | None = None) -> DataFrame:
        """A query's DataFrame, all its tables as of one commit.

        Bare COUNT, MIN and MAX over a table that nothing was changed in come from the files' footers.
        """
        self._register(sql, csn)
        sql = rewritten(sql)
        if not self.txn and (m := _BARE.match(sql)) and unquoted(m.group("table")).lower() in self.db.tables(csn):
            name = unquoted(m.group("table"))
            if (df := self.db.metadata(name, csn)) is not None:
                df.createOrReplaceTempView(self.db.spec(name).name)
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def sql(self, text: str, args: list | None = None) -> DataFrame | None:
        """Runs one statement: a DataFrame for a query, None otherwise (see ``affected``)."""
        text = text.strip().rstrip(";").strip()
        parts = [t for t, _, _ in tokens(text)]
        if ";" in parts:
            raise SqlError("one statement at a time")
        head = " ".join(parts[:2]).upper()
        self.affected = -1
        if _QUERY.match(text):
            return self.query(text, args)
        if args:
            text = _bound(text, args)
        if parts[:1] and parts[0].upper() in ("BEGIN", "COMMIT", "ROLLBACK", "END") or head == "START TRANSACTION":
            return self._control(parts[0].upper())
        if head == "CREATE TABLE":
            self.db.create(parse_create(text))
            self.affected = 0
        elif head == "DROP TABLE":
            if len(parts) != 3:
                raise SqlError("DROP TABLE takes one table")
            self.db.drop(unquoted(parts[2]))
            self.affected = 0
        elif parts[:1] and parts[0].upper() == "TRUNCATE":
            names = [p for p in parts[1:] if p.upper() != "TABLE"]
            if len(names) != 1:
                raise SqlError("TRUNCATE takes one table")
            self.db.truncate(unquoted(names[0]))
            self.affected = 0
        elif head.startswith("INSERT"):
            self._insert(text)
        elif head.startswith("UPDATE"):
            self._update(text)
        elif head.startswith("DELETE"):
            self._delete(text)
        elif head.startswith("COPY"):
            self._copy(text)
        else:
            raise SqlError(f"unknown statement: {text[:60]}")
        return None

    def _control(self, word: str) -> None:
        if word in ("BEGIN", "START"):
            if self.txn:
                raise OperationalError("a transaction is open")
            self.txn = Transaction(self.db)
            return
        if not self.txn:
            raise OperationalError("no transaction is open")
        txn, self.txn = self.txn, None
        if word in ("COMMIT", "END"):
            txn.commit()

    def _write(self, name: str, df: DataFrame, pure: bool) -> None:
        if self.txn:
            self.txn.add(name, df, pure)
            self.affected = self.txn.staged[-1][1].count()
            return
        path = self.db._stage(df)
        self.affected = self.spark.read.parquet(self.db._path(path)).count()
        if self.affected:
            self.db.commit([(name, path, pure)])
        else:
            self.db._unstage(path)

    def _insert(self, text: str) -> None:
        m = re.match(r"(?is)^INSERT\s+INTO\s+(\"[^\"]+\"|`[^`]+`|\w+)\s*(\((?!\s*SELECT\b)[^)]*\))?\s*(VALUES\b.*|\(?\s*(?:SELECT|WITH|TABLE)\b.*)$", text)
        if not m:
            raise SqlError("expected INSERT INTO table [(columns)] VALUES ... or a query")
        spec = self.db.spec(unquoted(m.group(1)))
        names = [spec.column(unquoted(c)).name for c in split_top(m.group(2).strip()[1:-1])] if m.group(2) else spec.names()
        if re.search(r"(?i)\bON\s+CONFLICT\b", text):
            raise SqlError("ON CONFLICT isn't supported; use upsert")
        rows = self.query("SELECT * FROM " + m.group(3)) if m.group(3).upper().startswith("VALUES") else self.query(m.group(3))
        if len(rows.columns) != len(names):
            raise SqlError(f"{len(rows.columns)} values for {len(names)} columns")
        rows = rows.toDF(*names)
        cols = [F.col(f"`{c.name}`") if c.name in names else (F.expr(c.default) if c.default else F.lit(None)).alias(c.name) for c in spec.columns]
        base = self.txn.next_rowid(spec.name) if self.txn else None
        self._write(spec.name, self.db.inserts(spec.name, rows.select(*cols), base), True)

    def _update(self, text: str) -> None:
        m = re.match(r"(?is)^UPDATE\s+(\"[^\"]+\"|`[^`]+`|\w+)\s+SET\s+(.*)$", text)
        if not m:
            raise SqlError("expected UPDATE table SET ...")
        spec = self.db.spec(unquoted(m.group(1)))
        body, where = _where(m.group(2))
        if any(t.upper() == "FROM" for t, _, _ in tokens(body)):
            raise SqlError("UPDATE ... FROM isn't supported")
        sets = {}
        for part in split_top(body):
            name, _, value = part.partition("=")
            sets[spec.column(unquoted(name.strip())).name] = value.strip()
        hit = self._hidden(spec.name).where(F.expr(where)) if where else self._hidden(spec.name)
        old = F.to_json(F.struct(*(F.col(f"`{n}`") for n in spec.names())), {"ignoreNullFields": "false"})
        value = lambda c: F.expr(sets[c.name]).cast("string")
        new = [(value(c).try_cast(c.type) if c.name in sets else F.col(f"`{c.name}`")).alias(c.name) for c in spec.columns]
        lost = [(value(c), value(c).try_cast(c.type)) for c in spec.columns if c.name in sets]
        bad = hit.where(F.greatest(*(x.isNotNull() & y.isNull() for x, y in lost), F.lit(False))).select(*(F.when(x.isNotNull() & y.isNull(), x) for x, y in lost)).first()
        if bad:
            raise DataError(f"{spec.name}: {next(x for x in bad if x is not None)!r} isn't a value of the column's type")
        hidden = [F.col("_rowid")] if spec.keyless else []
        if spec.key in sets:
            # a new key is a deletion and an insertion
            gone = self.db.deletes(spec.name, hit)
            fresh = hit.select(*new)
            spec.validate(fresh)
            fresh = fresh.withColumn("_op", F.lit("I")).withColumn("_old", F.lit(None).cast("string"))
            rest = self._hidden(spec.name).join(hit.select(F.col(f"`{spec.key}`").alias("_h")), F.col(f"`{spec.key}`") == F.col("_h"), "left_anti") if where else self._hidden(spec.name).limit(0)
            keys = fresh.select(F.col(f"`{spec.key}`").alias("k")).unionAll(rest.select(F.col(f"`{spec.key}`").alias("k")))
            twice = keys.groupBy("k").count().where("count > 1").first()
            if twice:
                from .errors import DuplicateKey

                raise DuplicateKey(f"{spec.name}: key {twice[0]!r} exists")
            kept = gone.join(fresh.select(F.col(f"`{spec.key}`").alias("_h")), F.col(f"`{spec.key}`") == F.col("_h"), "left_anti")
            n = hit.count()
            self._write(spec.name, kept.unionByName(fresh), False)
            self.affected = n
            return
        df = hit.select(*new, *hidden, F.lit("U").alias("_op"), old.alias("_old"))
        spec.validate(df)
        self._write(spec.name, df, False)

    def _delete(self, text: str) -> None:
        m = re.match(r"(?is)^DELETE\s+FROM\s+(\"[^\"]+\"|`[^`]+`|\w+)\s*(.*)$", text)
        if not m:
            raise SqlError("expected DELETE FROM table [WHERE ...]")
        name, (body, where) = unquoted(m.group(1)), _where(m.group(2))
        if body.strip():
            raise SqlError(f"can't read {body!r}")
        self.db.spec(name)
        rows = self._hidden(name)
        self._write(name, self.db.deletes(name, rows.where(F.expr(where)) if where else rows), False)

    def _copy(self, text: str) -> None:
        name, columns, path, opts = parse_copy(text)
        spec: TableSpec = self.db.spec(name)
        rows = read_delimited(self.spark, path, spec, columns, **opts)
        base = self.txn.next_rowid(spec.name) if self.txn else None
        self._write(name, self.db.inserts(name, rows, base), True)


def _where(text: str) -> tuple[str, str | None]:
    depth = 0
    for tok, start, end in tokens(text):
        depth += (tok == "(") - (tok == ")")
        if depth == 0 and tok.upper() == "WHERE":
            return text[:start], text[end:].strip()
    return text, None


def _bound(text: str, args: list) -> str:
    """Positional ``?`` outside strings replaced by literals."""
    out, at, left = [], 0, list(args)
    for tok, start, end in tokens(text):
        if tok == "?":
            if not left:
                raise SqlError("fewer values than placeholders")
            out += [text[at:start], literal(left.pop(0))]
            at = end
    if left:
        raise SqlError("more values than placeholders")
    return "".join(out) + text[at:]


def literal(v) -> str:
    """A SQL literal of a Python value."""
    import datetime
    import decimal

    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L" if abs(v) >= 2**31 else str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Transaction:
    """Changes on top of a pinned snapshot, visible to itself only until they commit."""

    def __init__(self, db: Database):
        self.db, self.csn = db, db.csn()
        self._pin = db.pin(self.csn)
        self._pin.__enter__()
        self.staged: list[tuple[str, DataFrame, bool]] = []

    def next_rowid(self, name: str) -> int:
        """Above every rowid of the table and of this transaction."""
        top = self.db._table(name)["next_rowid"]
        for n, df, _ in self.staged:
            if n.lower() == name.lower() and "_rowid" in df.columns:
                top = max(top, (df.agg(F.max("_rowid")).first()[0] or 0) + 1)
        return top

    def table(self, name: str, hidden: bool = False) -> DataFrame:
        t = self.db._table(name, self.csn) if name.lower() in self.db.tables(self.csn) else self.db._table(name)
        spec, rows = t["spec"], self.db._live(t)
        k = F.col(f"`{spec.key}`")
        for n, df, _ in self.staged:
            if n.lower() == name.lower():
                cols = [F.col(f"`{c}`") for c in spec.names(hidden=True)]
                rows = rows.join(df.select(k.alias("_t")), k == F.col("_t"), "left_anti").select(*cols).unionAll(df.where("_op <> 'D'").select(*cols))
        return rows.select(*(F.col(f"`{n}`") for n in spec.names(hidden)))

    def add(self, name: str, df: DataFrame, pure: bool) -> None:
        spec = self.db.spec(name)
        if pure and not spec.keyless:
            k = F.col(f"`{spec.key}`").alias("k")
            from .errors import DuplicateKey

            twice = df.groupBy(k).count().where("count > 1").first() or df.select(k).join(self.table(name).select(k), "k", "left_semi").first()
            if twice:
                raise DuplicateKey(f"{name}: key {twice[0]!r} exists")
        path = self.db._stage(df)
        self.staged.append((spec.name, self.db.spark.read.parquet(self.db._path(path)), pure))

    def commit(self) -> int | None:
        """One commit with each key's first pre-image and last state; the first committer of a key wins."""
        try:
            merged = []
            for name in dict.fromkeys(n for n, _, _ in self.staged):
                spec = self.db.spec(name)
                cols = [*spec.names(hidden=True), "_op", "_old"]
                parts = [df.select(*(F.col(f"`{c}`") for c in cols)).withColumn("_seq", F.lit(i)) for i, (n, df, _) in enumerate(self.staged) if n == name]
                rows = parts[0]
                for p in parts[1:]:
                    rows = rows.unionAll(p)
                k = F.col(f"`{spec.key}`")
                last = rows.groupBy(k.alias("_k")).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in cols)), "_seq").alias("v"), F.min_by(F.struct("_old"), "_seq").alias("f"))
                op = F.when(F.col("f._old").isNull(), F.when(F.col("v._op") == "D", "-").otherwise("I")).when(F.col("v._op") == "D", "D").otherwise("U")
                out = last.select(*(F.col(f"v.`{c}`").alias(c) for c in spec.names(hidden=True)), op.alias("_op"), F.col("f._old").alias("_old")).where("_op <> '-'")
                if not out.isEmpty():
                    merged.append((name, out, all(p for n, _, p in self.staged if n == name)))
            return self.db.commit(merged, since=self.csn) if merged else None
        finally:
            self.rollback()

    def rollback(self) -> None:
        if self._pin:
            self._pin.__exit__(None, None, None)
            self._pin = None
