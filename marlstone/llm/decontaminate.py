"""Benchmark decontamination by the q-gram lemma.

Two strings of m signs within k edits share at least m + 1 - q (k + 1) q-grams, all on k + 1
neighbouring diagonals.  Benchmark items are cut into overlapping windows with an edit budget.

1. Every position of every text is tested against the set of the benchmark's q-grams; a stretch as
   long as a window with too few members cannot hold a match and is dropped.  This costs a few
   array operations a byte and leaves next to nothing of a clean text.
2. In the stretches that are left, shared q-grams are counted by window and diagonal band; bands
   overlap, so that any k + 1 neighbouring diagonals lie in one of them.  Bands that meet the bound
   are verified by banded alignment.

Texts and items are compared in lower case with every run of other signs than letters and figures
as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bounded_batches, lean

Q = 8
_M = np.uint64(0x9E3779B97F4A7C15)
#: The first test's bits: so many for each distinct q-gram of a slice, at least and at most 2 to the power of these.
SPARSE, LEAST_BITS, MOST_BITS = 32, 16, 28
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def simplify(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, original place of each byte): a space before each word of a text, and one after the last."""
    low = K.lower(data)
    word = _WORD[low]
    start, end = K.runs(word, off)
    owner = np.searchsorted(off, start, "right") - 1
    per = np.bincount(owner, minlength=len(off) - 1)
    size = end - start + 1
    n_out = np.add.reduceat(size, (np.cumsum(per) - per)[per > 0]) if len(size) else np.zeros(0, np.int64)
    total = np.zeros(len(off) - 1, np.int64)
    total[per > 0] = n_out + 1
    noff = np.concatenate([[0], np.cumsum(total)])
    out, src = np.full(int(noff[-1]), 32, np.uint8), np.zeros(int(noff[-1]), np.int64)
    if len(start):
        at = np.cumsum(size) - size + owner_shift(per)
        src[at] = start
        flat = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        to, of = np.repeat(at + 1, size - 1) + flat, np.repeat(start, size - 1) + flat
        out[to], src[to] = low[of], of
        src[noff[1:][per > 0] - 1] = end[np.cumsum(per)[per > 0] - 1]
    return out, noff, src


def owner_shift(per: np.ndarray) -> np.ndarray:
    """For each word, how many texts with words end before it: each has one closing space."""
    return np.repeat(np.cumsum(per > 0) - (per > 0), per)


def _grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, Q)).view(np.uint64).reshape(-1)


class Index:
    """Windows of the benchmark's items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], window: int, step: int, rate: float):
        data, off = K.text_buffers(pa.array([t for _, t in items], pa.large_string()))
        text, noff, _ = simplify(data, off)
        self.item, self.start, self.size, parts = [], [], [], []
        for i, (item, _) in enumerate(items):
            s = text[noff[i] : noff[i + 1]]
            if len(s) < Q:
                continue
            last = max(0, len(s) - window)
            for a in sorted({*range(0, last, step), last}):
                p = s[a : a + window]
                self.item.append(item)
                self.start.append(a)
                self.size.append(len(p))
                parts.append(p)
        self.parts = parts
        size = np.array(self.size, np.int64)
        k = np.floor(rate * size).astype(np.int64)
        # the budget is cut where the lemma would promise no shared q-gram
        self.k = np.minimum(k, np.maximum((size - Q + 1 - 1) // Q, 0))
        self.need = size + 1 - Q * (self.k + 1)
        gram, win, pos = [], [], []
        for w, p in enumerate(parts):
            g = _grams(p)
            gram.append(g)
            win.append(np.full(len(g), w))
            pos.append(np.arange(len(g)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        gram, win, pos = cat(gram, np.uint64), cat(win, np.int64), cat(pos, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.win, self.pos = gram[order], win[order], pos[order]
        # one in SPARSE strange q-grams passes the first test, whatever the benchmark's size
        distinct = 1 + int((self.gram[1:] != self.gram[:-1]).sum()) if len(self.gram) else 0
        self.bits = min(MOST_BITS, max(LEAST_BITS, (SPARSE * distinct).bit_length()))
        self.member = np.zeros((1 << self.bits) // 8, np.uint8)
        at = (self.gram * _M) >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.member, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        #: Diagonals are counted from here, so that none is negative.
        self.shift = int(size.max()) + 1 if len(size) else 1
        #: (length, least count) of each kind of window, for the first test.
        self.kinds = sorted({(int(s), int(n), int(e)) for s, n, e in zip(size, self.need, self.k, strict=True)})

    def stretches(self, hits: np.ndarray) -> np.ndarray:
        """Whether each q-gram position lies in a stretch that may hold a match of some window."""
        total = np.concatenate([[0], np.cumsum(hits)])
        keep = np.zeros(len(hits) + 1, np.int32)
        n = len(hits)
        # windows of nearly one length are tested together, with the longest stretch and the least count among them
        groups: dict[int, tuple[int, int]] = {}
        for size, need, k in self.kinds:
            span = size + k - Q + 1
            a, b = groups.get(span // 16, (0, 1 << 30))
            groups[span // 16] = (max(a, span), min(b, need))
        for span, need in groups.values():
            end = np.minimum(np.arange(n) + span, n)
            ok = np.flatnonzero(total[end] - total[:n] >= need)
            np.add.at(keep, ok, 1)
            np.add.at(keep, np.minimum(ok + span, n), -1)
        return np.cumsum(keep[:-1]) > 0

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, window, start, end, edits) in the bytes of ``data``: the best place in each band that verifies."""
        g = _grams(data)
        if not len(g) or not len(self.gram):
            return []
        slot = (g * _M) >> np.uint64(64 - self.bits)
        hit = (self.member[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        for back in range(1, Q):  # q-grams don't reach into the next text
            at = off[1:-1] - back
            hit[at[(at >= 0) & (at < len(hit))]] = False
        at = np.flatnonzero(hit & self.stretches(hit))
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        count = hi - lo
        place = np.repeat(at, count)
        row = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        win, text = self.win[row], np.searchsorted(off, place, "right") - 1
        diag = place - self.pos[row]
        # bands of 2 (k + 1) diagonals, one every k + 1
        width = self.k[win] + 1
        band = (diag + self.shift) // width
        win, text, band, place = (np.concatenate([x, x]) for x in (win, text, band, place))
        band[len(band) // 2 :] -= 1
        key = np.lexsort((place, band, win, text))
        win, text, band, place = win[key], text[key], band[key], place[key]
        new = np.ones(len(win), bool)
        new[1:] = (win[1:] != win[:-1]) | (text[1:] != text[:-1]) | (band[1:] != band[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(win)))
        good = np.flatnonzero(sizes >= self.need[win[heads]])
        cands = []
        for h in heads[good]:
            k = int(self.k[win[h]])
            first = int(band[h]) * (k + 1) - self.shift
            cands.append((int(text[h]), int(win[h]), first, first + 2 * (k + 1) - 1))
        return self._verify(data, off, cands)

    def _verify(self, data, off, cands):
        """Banded alignment of all candidates of one length and budget at once."""
        out, groups = [], {}
        for c in cands:
            groups.setdefault((self.size[c[1]], int(self.k[c[1]])), []).append(c)
        for (m, k), group in groups.items():
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                pat = np.stack([self.parts[w] for _, w, _, _ in part])
                # diagonals first - k .. last + k: starts of the match are free in the band
                wide = 2 * (k + 1) + 2 * k
                base = np.array([f - k for _, _, f, _ in part])
                lim_lo, lim_hi = off[[t for t, _, _, _ in part]], off[[t + 1 for t, _, _, _ in part]]
                cost, origin = align(data, pat, base, lim_lo, lim_hi, wide, k)
                best = np.argmin(cost, axis=1)
                for i, (t, w, _, _) in enumerate(part):
                    e = int(cost[i, best[i]])
                    if e <= k:
                        out.append((t, w, int(origin[i, best[i]]), int(base[i] + best[i] + m), e))
        return out


def align(data: np.ndarray, pat: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, wide: int, k: int):
    """Edit distance of each pattern to the text along a band of diagonals, from any start in the band.

    Cell d of row i stands for pattern[:i] against the text up to place base + d + i.  Returns the
    last row and, for each cell, where its match starts.
    """
    n, m = pat.shape
    d = np.arange(wide)
    far = 1 << 30
    low = int(wide).bit_length()
    place = base[:, None] + d
    inside = (place >= lo[:, None]) & (place <= hi[:, None])
    cost = np.where(inside, 0, far)
    origin = place.copy()
    for i in range(1, m + 1):
        place = base[:, None] + d + i  # text used up to here
        ok = (place >= lo[:, None]) & (place <= hi[:, None])
        sign = data[np.clip(place - 1, 0, len(data) - 1)]
        diag = cost + (sign != pat[:, i - 1 : i])
        diag[place - 1 < lo[:, None]] = far
        up = np.full_like(cost, far)  # a sign of the pattern that the text lacks: one diagonal to the right in the row above
        up[:, :-1] = cost[:, 1:] + 1
        up_o = np.zeros_like(origin)
        up_o[:, :-1] = origin[:, 1:]
        new, o = np.where(up < diag, up, diag), np.where(up < diag, up_o, origin)
        # signs of the text that the pattern lacks: from the left in the same row, a running minimum
        score = ((new - d) << low) + d
        run = np.minimum.accumulate(score, axis=1)
        src = run & ((1 << low) - 1)
        left = (run >> low) + d
        better = left < new
        new = np.where(better, left, new)
        o = np.where(better, np.take_along_axis(o, src, 1), o)
        cost, origin = np.where(ok, np.minimum(new, far), far), o
    return cost, origin


def _scan(held):
    def run(batches):
        index = held.value
        for b in batches:
            ids = b.column(0).to_pylist()
            data, off = K.text_buffers(b.column(1))
            rows = []
            for lo, hi in K.chunks(off):
                text, noff, src = simplify(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                best: dict[tuple[int, int], tuple] = {}
                for t, w, s, e, edits in index.matches(text, noff):
                    key, got = (t, index.item[w]), (edits / index.size[w], edits, int(s), int(e))
                    if key not in best or got < best[key]:
                        best[key] = got
                for (t, item), (_, edits, s, e) in sorted(best.items()):
                    base = off[lo + t] - off[lo]
                    s, e = max(s, noff[t]), min(max(e, s + 1), noff[t + 1])
                    rows.append((ids[lo + t], item, edits, int(src[s] - base), int(src[e - 1] + 1 - base)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "start", "end"])

    return run


SCHEMA = "doc_id long, item_id long, edits long, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 100, step: int = 20, rate: float = 0.06, slice_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each document and benchmark item of which it holds a passage.

    A passage is a window of ``window`` signs of an item (the whole item if it is shorter), one
    every ``step`` signs, within ``rate`` edits a sign.  start and end are bytes of the original
    text; where several windows match, the one with the fewest edits a sign is reported, then the
    first.  Items of fewer than eight signs hold no q-gram and are never matched.

    Null and empty texts hold nothing, null items are skipped; a null doc_id stays null.  Rows are
    scanned one by one, whole, so repeated rows give repeated results; items that share an id are one.
    Other columns are ignored.  The benchmark is broadcast in slices of at most ``slice_bytes`` of
    text; a larger one costs a pass over the documents for each slice.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    out = None
    for index in _slices(items, window, step, rate, slice_bytes):
        part = src.mapInArrow(lean(_scan(docs.sparkSession.sparkContext.broadcast(index))), SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def _slices(items: DataFrame, window: int, step: int, rate: float, slice_bytes: int) -> Iterator[Index]:
    """Indexes of about ``slice_bytes`` of text each; items that share an id are in one."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    for i in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).orderBy("item_id", "text").collect()
        yield Index([(r[0], r[1]) for r in rows], window, step, rate)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a passage of the benchmark; all columns as they are.

    Rows without doc_id are judged by their own text too.  Null and empty texts stay.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for index in _slices(items, **({"window": 100, "step": 20, "rate": 0.06, "slice_bytes": 8 << 20} | how)):
        docs = docs.mapInArrow(lean(_keep(docs.sparkSession.sparkContext.broadcast(index), at)), docs.schema)
    return docs


def _keep(held, at: int):
    def run(batches):
        for b in batches:
            data, off = K.text_buffers(b.column(at))
            clean = np.ones(len(b), bool)
            for lo, hi in K.chunks(off):
                text, noff, _ = simplify(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for t, *_ in held.value.matches(text, noff):
                    clean[lo + t] = False
            yield b.filter(pa.array(clean))

    return run
