"""Secret scans by multipart credential linking.

One pass over the texts finds credential parts: access identifiers, secrets and endpoints, each
strong (its form alone gives it away) or weak.  An interval join then links each secret with the
identifiers and endpoints of its scope: the same text, at most ``REACH`` signs away.  Strong parts
are reported as they are; a weak secret only when an identifier or endpoint is in its scope.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bounded_batches, lean

#: Signs between a secret and what belongs to it.
REACH = 400

#: (name, part, strong, pattern; the value is the first group, or all of it).
RULES = [
    ("private_key", "secret", True, r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),
    ("source_host_token", "secret", True, r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("chat_token", "secret", True, r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("signed_token", "secret", True, r"\b(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    ("url_with_password", "secret", True, r"(?<![a-z0-9+.-])[a-z0-9+.-]+://[^\s:/@]+:([^\s:/@]{3,})@[^\s/]+"),
    ("assigned_secret", "secret", False, r"(?i)(?:secret(?:[_-]?(?:access[_-]?)?key)?|token|passw(?:or)?d|passwd|pwd|(?:api|auth|private)[_-]?key)\b[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?([^\s\"',;]{8,})"),
    ("long_base64", "secret", False, r"(?<![A-Za-z0-9+/=_-])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=_-])"),
    ("cloud_key_id", "identifier", False, r"\b((?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16})\b"),
    ("assigned_id", "identifier", False, r"(?i)\b(?:client[_-]?id|access[_-]?key[_-]?id|account[_-]?id|user(?:name)?|login|tenant[_-]?id)\b[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?([^\s\"',;]{3,})"),
    ("mail_address", "identifier", False, r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)\b"),
    ("url", "endpoint", False, r"\b((?:https?|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,})"),
    ("ip_address", "endpoint", False, r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?)(?![\d.])"),
    ("assigned_host", "endpoint", False, r"(?i)\b(?:host(?:name)?|server|endpoint|base[_-]?url)\b[\"']?\s{0,3}(?:=|:)\s{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9.-]{2,}(?::\d{1,5})?)"),
]
_COMPILED = [(n, p, s, re.compile(x)) for n, p, s, x in RULES]

#: Only a text with a sign of a secret is searched; linear-time matching over the column.
_ANY_SECRET = r"(?i)-----BEGIN|gh[pousr]_|xox[abprs]-|eyJ|://[^\s/]*@|secret|token|passw|pwd|(?:api|auth|private|[_-])key|[A-Za-z0-9+/]{40}"

PARTS = "doc_id long, rid long, rule string, part string, strong boolean, start long, end long, value string"


def find_parts(text: str) -> list[tuple[str, str, bool, int, int, str]]:
    """(rule, part, strong, start, end, value); of overlapping secrets only the first rule's."""
    out, taken = [], []
    for name, part, strong, rx in _COMPILED:
        for m in rx.finditer(text):
            g = 1 if rx.groups else 0
            if part == "secret":
                if any(a < m.end(g) and m.start(g) < b for a, b in taken):
                    continue
                taken.append((m.start(g), m.end(g)))
            out.append((name, part, strong, m.start(g), m.end(g), m.group(g)))
    return out


def parts(docs: DataFrame) -> DataFrame:
    """Every credential part of the texts that hold a secret; places are characters."""

    def run(batches):
        for b in batches:
            text = K.column(b.column(2))
            at = pc.indices_nonzero(pc.match_substring_regex(text, _ANY_SECRET)).to_pylist()
            ids, rids, rows = b.column(0), b.column(1), []
            for i in at:
                found = find_parts(text[i].as_py())
                if any(p == "secret" for _, p, *_ in found):
                    rows += [(ids[i].as_py(), rids[i].as_py(), *f) for f in found]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text")).where("text is not null")
    return src.mapInArrow(lean(run), PARTS)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, rule, start, end, strength, identifiers, endpoints, redacted, fingerprint), one row a secret.

    start and end count characters.  ``strength`` is strong or linked.  identifiers and endpoints
    list (rule, start, end) of the parts in scope by place.  The value itself isn't given: only its
    first four signs and its SHA-256.  Null and empty texts hold nothing; a null doc_id stays null;
    repeated rows are reported once; rows that share a doc_id but not the text are scopes of their
    own; texts are searched whole.  Other columns are ignored.
    """
    found = parts(docs).distinct()
    first, last = F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)
    secret = found.where("part = 'secret'").select("doc_id", "rid", "rule", "strong", "start", "end", "value", F.explode(F.sequence(first - 1, last + 1)).alias("b"))
    other = found.where("part <> 'secret'").select(F.col("doc_id").alias("o_doc"), F.col("rid").alias("o_rid"), "part", F.struct("start", "end", "rule").alias("o"), F.explode(F.sequence(first, last)).alias("o_b"))
    gap = F.greatest(F.col("o.start") - F.col("end"), F.col("start") - F.col("o.end"), F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("rid") == F.col("o_rid")) & (F.col("b") == F.col("o_b"))
    inside = (F.col("o.start") < F.col("end")) & (F.col("start") < F.col("o.end"))
    linked = secret.join(other, same & (gap <= reach) & ~inside, "left")
    per = linked.groupBy("doc_id", "rid", "rule", "strong", "start", "end", "value").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("part") == p, F.col("o")))).alias(f"{p}s") for p in ("identifier", "endpoint"))
    )
    shown = per.where(F.col("strong") | (F.size("identifiers") > 0) | (F.size("endpoints") > 0))
    return shown.select("doc_id", "rule", "start", "end", F.when(F.col("strong"), "strong").otherwise("linked").alias("strength"), "identifiers", "endpoints", F.concat(F.substring("value", 1, 4), F.lit("...")).alias("redacted"), F.sha2("value", 256).alias("fingerprint"))
