"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one bit vector of as many 64-bit words as they need: a bit for each
place in each rule.  One Shift-And step per sign of the URL advances every rule at once; a star is a
place that keeps its bit.  A batch of URLs goes through the steps together, longest first, so each
step touches only the URLs that still have signs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import lean

#: (rule name, glob over the canonical URL): ``*`` any signs, ``?`` one ASCII sign; the whole URL must match.
DEFAULT_RULES = [
    ("casino", "*casino*"), ("betting", "*free-bets.*"), ("pills", "*cheap-pills*"), ("ad_tracker", "*ads-track.*"), ("ad_server", "ads?.*"),
    ("adult", "*xxx*"), ("porn", "*porn*"), ("payday", "*payday-loan*"), ("warez", "*warez*"), ("torrent", "*/torrent/*"),
    ("login", "*/login*"), ("signup", "*/signup*"), ("cart", "*/cart/*"), ("checkout", "*/checkout*"), ("admin", "*/wp-admin/*"),
    ("search", "*/search?*q=*"), ("calendar", "*/calendar/????/??*"), ("print", "*&print=1*"), ("session", "*sessionid=*"), ("replytocom", "*replytocom=*"),
    ("image", "*.jp?g"), ("png", "*.png"), ("archive", "*.zip"), ("binary", "*.exe"), ("video", "*.mp4"),
    ("local", "localhost*"), ("loopback", "127.*.*.*"), ("private", "192.168.*"), ("onion", "*.onion/*"), ("paged", "*/en/????.html"),
]


def canonical(url: Column) -> Column:
    """Host and path without scheme, www., default port, fragment, tracking parameters and a closing slash; lower case."""
    u = F.lower(F.regexp_replace(url, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    for pattern, by in CANONICAL_STEPS:
        u = F.regexp_replace(u, pattern, by)
    return u


#: Replacements in this order; the same in Java's and RE2's syntax.
CANONICAL_STEPS = [
    (r"#.*$", ""), (r"^[a-z][a-z0-9+.-]*://", ""), (r"^www\.", ""), (r"^([^/?]*):(80|443)([/?]|$)", "$1$3"),
    (r"([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*", "$1"), (r"&&+", "&"), (r"\?&+", "?"), (r"[?&]+$", ""), (r"/+$", ""),
]


class Automaton:
    """Shift-And masks of many globs."""

    def __init__(self, globs: list[str]):
        bits, star, accept, start = [], [], [], []
        for g in globs:
            start.append(len(bits))
            bits.append(None)  # the place before the first sign
            star.append(False)
            for c in g.encode():
                if c == ord("*"):
                    star[-1] = True
                else:
                    bits.append(c)
                    star.append(False)
            accept.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.step, self.stay, self.begin = np.zeros((256, self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for i, (c, s) in enumerate(zip(bits, star, strict=True)):
            bit = np.uint64(1) << np.uint64(i % 64)
            if c == ord("?"):
                self.step[:128, i // 64] |= bit
            elif c is not None:
                self.step[c, i // 64] |= bit
            if s:
                self.stay[i // 64] |= bit
        for i in start:
            self.begin[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        self.accept = [(i // 64, np.uint64(i % 64)) for i in accept]

    def match(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Boolean (texts, rules)."""
        n, size = len(off) - 1, np.diff(off)
        order = np.argsort(-size, kind="stable")
        live = np.tile(self.begin, (n, 1))
        base, size = off[:-1][order], size[order]
        for i in range(int(size[0]) if n else 0):
            m = int(np.searchsorted(-size, -i, "left"))  # URLs longer than i
            d = live[:m]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[:m] = (moved & self.step[data[base[:m] + i]]) | (d & self.stay)
        out = np.zeros((n, len(self.accept)), bool)
        for r, (w, b) in enumerate(self.accept):
            out[order, r] = (live[:, w] >> b & np.uint64(1)).astype(bool)
        return out


def check(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(page_id, canonical_url, rules, blocked): the sorted names of the rules that each page's URL matches.

    A null URL is canonically null and matches nothing; an empty one is matched as an empty text.
    Rows are judged one by one: repeated rows give repeated results, a null page_id stays null, other
    columns (the page itself) aren't read.  URLs of any length are read whole.  Rules that share a
    name are one rule.  A sign outside ASCII in a glob stands for itself, ``?`` for one ASCII sign.
    """
    rules = DEFAULT_RULES if rules is None else rules
    names = [n for n, _ in rules]
    held = pages.sparkSession.sparkContext.broadcast(Automaton([g for _, g in rules]))

    def run(batches):
        for b in batches:
            data, off = K.text_buffers(b.column(1))
            url = b.column(1)
            for lo in range(0, len(b), 4096):
                hi = min(lo + 4096, len(b))
                got = held.value.match(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                null = url.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                found = [[] if gone else sorted({names[j] for j in np.flatnonzero(row)}) for row, gone in zip(got, null, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), url.slice(lo, hi - lo), pa.array(found, pa.list_(pa.string())), pa.array([bool(x) for x in found])], names=["page_id", "canonical_url", "rules", "blocked"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), canonical(F.col("url").cast("string")).alias("canonical_url"))
    return src.mapInArrow(lean(run), "page_id long, canonical_url string, rules array<string>, blocked boolean")


def oracle(rules: list[tuple[str, str]] | None = None) -> str:
    """The same in DuckDB: one LIKE a rule."""
    url = r"regexp_replace(url, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
    url = f"lower({url})"
    for pattern, by in CANONICAL_STEPS:
        by = by.replace("$1", "\\1").replace("$3", "\\3")
        url = f"regexp_replace({url}, '{pattern}', '{by}', 'g')"
    like = lambda g: g.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    tests = ", ".join(f"CASE WHEN u LIKE '{like(g)}' ESCAPE '\\' THEN '{n}' END" for n, g in (DEFAULT_RULES if rules is None else rules))
    return f"""SELECT page_id, u AS canonical_url, r AS rules, len(r) > 0 AS blocked
FROM (SELECT page_id, u, list_sort(list_distinct(list_filter([{tests}], lambda x: x IS NOT NULL))) AS r
FROM (SELECT page_id, {url} AS u FROM pages))"""
