"""Following JSON lines that another process writes: a folder of files as a stream, or one growing file."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes as the JSON-lines sink writes them; rows stay JSON.
CHANGE = "table string, op string, csn bigint, old string, new string"


def stream_jsonl(spark: SparkSession, folder: str, schema: str = CHANGE) -> DataFrame:
    """The lines of all files below a folder, those added later too, as a streaming DataFrame; lines that can't be read are dropped."""
    text = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    return text.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


class Tail:
    """The complete lines of one growing file after a byte offset, as parsed JSON.

    ``offset`` is where to go on; with ``cursor``, a file that holds it, a new process goes on where
    the last one stopped.  A line without its end yet is left for later; empty lines are skipped.
    """

    def __init__(self, path: str, cursor: str | None = None, offset: int = 0, block: int = 1 << 20):
        self.path, self.cursor, self.offset, self.block = path, cursor, offset, block
        if cursor and os.path.exists(cursor):
            with open(cursor) as f:
                self.offset = int(f.read() or 0)

    def poll(self) -> Iterator[dict]:
        """The lines that are there now; the offset moves with each."""
        if not os.path.exists(self.path):
            return
        with open(self.path, "rb") as f:
            f.seek(self.offset)
            left = b""
            while part := f.read(self.block):
                lines = (left + part).split(b"\n")
                left = lines.pop()
                for line in lines:
                    self.offset += len(line) + 1
                    if line.strip():
                        yield json.loads(line)
        self.save()

    def save(self) -> None:
        if self.cursor:
            with open(self.cursor + ".new", "w") as f:
                f.write(str(self.offset))
            os.replace(self.cursor + ".new", self.cursor)

    def follow(self, idle: float | None = None, look: float = 0.05) -> Iterator[dict]:
        """Lines as they come, until none came for ``idle`` seconds (without it, for ever)."""
        last = time.monotonic()
        while idle is None or time.monotonic() - last < idle:
            for row in self.poll():
                last = time.monotonic()
                yield row
            time.sleep(look)
