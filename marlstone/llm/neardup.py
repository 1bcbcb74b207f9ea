"""N-gram Jaccard join by an exact prefix filter, verified on full n-gram sets.

1. Texts with equal n-gram sets are one set from here on, told by a hash of the set.
2. N-grams are ordered by rarity, from counting sketches of bounded size; any order is lossless.  The
   n-grams' own sketch fills as the input grows and then tells only those that are very common; the
   others are ordered by how common their words are, whose number grows far less.  Of n
   n-grams two sets at the threshold t share one among the first n - ceil(t n) + 1 of each, and k among
   the first n - ceil(t n) + k.  These go to the part of their hash, where sets that share one and
   aren't too unlike in size are candidates.  A set with fewer than k such n-grams has no partner, so
   only few sets go further, even where the sketch is full and rare n-grams can't be told.  For the same
   reason a set leaves out those hubs (below) that hold fewer than half of these n-grams together.
3. The smallest set of those that share an n-gram is their hub, and the n-grams of one hub are one
   gathering: near copies share most of their hubs, so a text travels to a few places, however
   many n-grams it shares.
4. Each gathering's texts come together and its candidates are verified on the full sets, by
   products of membership matrices over the n-grams that occur twice.  A gathering larger than
   ``BLOCK`` is split into pairs of blocks, which are verified apart: nothing is capped, no gathering is
   one task, and a pair counts only in the smallest gathering that both are in.

Dropping copies needs no pair for each two of a group: every document is verified against its hubs
first, and only candidates that this leaves in different groups are verified with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph.components import connected_components
from . import textkernel as K
from .common import bounded_batches, key_filter, lean, may_be_in, written
from .linededup import _parts, _sketch

#: Documents of a gathering compared with each other at a time.
BLOCK = 768
#: How many n-grams of a set must be shared, as a share of its size; prefixes are longer by as many.
EXTRA = 0.15
#: Bits of a hash that choose its part, and n-grams that a task holds before it sends them there.
PART_BITS, HELD = 10, 1 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count of each text): word n-grams in lower case; all words together where there are fewer than n."""
    return _shingled(data, off, n)[:2]


def _shingled(data: np.ndarray, off: np.ndarray, n: int, weigh=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingles``, with the words' hashes and, for each n-gram, the sum of what ``weigh`` gives its words (0 without)."""
    low = K.lower(data)
    start, end = K.runs(~(K.SPACE[low] | (low == K.LINE_END)), off)
    words = K.hash_ranges(low, start, end)
    per = np.bincount(np.searchsorted(off, start, "right") - 1, minlength=len(off) - 1)
    out, total = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    weight = weigh(words) if weigh else total
    size = np.repeat(per, per)
    left = size - (np.arange(len(words)) - np.repeat(np.cumsum(per) - per, per))  # words from here to the text's end
    for j in range(n):
        take = np.minimum(np.arange(len(words)) + j, len(words) - 1)
        out += np.where(left > j, words[take] * _C[j % 8] + np.uint64(j // 8), np.uint64(0))
        if weigh:
            total += np.where(left > j, weight[take], 0)
    use = (left >= n) | (left == size) & (size < n)
    count = np.where(per >= n, per - n + 1, np.minimum(per, 1))
    return K.mix(out[use]), count, words, total[use]


def _count(ngram: int, bits: int):
    """Counts of 2**bits buckets of n-grams, then of as many of words."""

    def run(batches):
        counts, some = np.zeros(2 << bits, np.uint32), False
        for b in batches:
            data, off = K.text_buffers(b.column(0))
            for lo, hi in K.chunks(off):
                h, _, words, _ = _shingled(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngram)
                np.add.at(counts, _bucket(h, bits), np.uint32(1))
                np.add.at(counts, (1 << bits) + _bucket(words, bits), np.uint32(1))
                some = some or len(h) > 0
        yield from _parts(counts if some else counts[:0])

    return run


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _usual(sketch: np.ndarray, bits: int) -> int:
    """The sketched count up to which a bucket of n-grams says no more than how full the sketch is."""
    m = float(np.median(sketch[: 1 << bits]))
    m = 2 ** ((m - 1) / 8) if m else 0.0
    return round(8 * math.log2(m + 6 * math.sqrt(m) + 1)) + 1


def _sets(data: np.ndarray, off: np.ndarray, ngram: int, sketch: np.ndarray | None = None, bits: int = 0, usual: int = 0):
    """(hashes, sketched counts, size of each text's set): distinct n-grams, rarest first."""
    weigh = None if sketch is None else lambda words: sketch[(1 << bits) + _bucket(words, bits)].astype(np.int64)
    h, count, _, rank = _shingled(data, off, ngram, weigh)
    text = np.repeat(np.arange(len(count)), count)
    q = sketch[_bucket(h, bits)] if sketch is not None else np.zeros(len(h), np.uint8)
    # common n-grams come last, though their words may be rare; a count is 8 log2 of it, so the words' sum is their product's
    order = np.lexsort((h, np.where(q > usual, (1 << 40) + q.astype(np.int64), rank), text))
    h, q, text = h[order], q[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], q[new], np.bincount(text[new], minlength=len(count))


def _identity(h: np.ndarray, size: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A hash of each set that isn't empty."""
    return np.add.reduceat(K.mix(h ^ salt), (np.cumsum(size) - size)[size > 0]).view(np.int64) if len(h) else np.zeros(0, np.int64)


def _identities(ngram: int):
    def run(batches):
        for b in batches:
            data, off = K.text_buffers(b.column(1))
            for lo, hi in K.chunks(off):
                h, _, size = _sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngram)
                some = pa.array(size > 0)
                whose = [b.column(i).slice(lo, hi - lo).filter(some) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*whose, pa.array(_identity(h, size, _C[2])), pa.array(_identity(h, size, _C[3])), pa.array(size[size > 0])], names=["doc", "rid", "k1", "k2", "n"])

    return run


def _least_size(size: np.ndarray, t: float) -> np.ndarray:
    """ceil(t n): what a set shares at least with any that is alike, and the least size of those."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _prefixes(ngram: int, t: float, sketch, bits: int, usual: int):
    """Rows (part, entries): an n-gram's hash within its part, its set and the class of the set's size, of each prefix."""

    def send(held):
        h, k1, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        part = h >> np.uint64(64 - PART_BITS)
        order = np.argsort(part, kind="stable")
        h, k1, kind, part = (h >> np.uint64(32 - PART_BITS)).astype(np.uint32)[order], k1[order], kind[order], part[order]
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(at[1:], len(part))
        cols = [[x[i:j].tobytes() for i, j in zip(at, ends, strict=True)] for x in (h, k1, kind)]
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *(pa.array(x, pa.binary()) for x in cols)], names=["part", "h", "k1", "kind"])

    def run(batches):
        held, n = [], 0
        # sets as alike as t are in one class or in neighbouring ones
        width = math.log(max(1 / t, 1.1))
        for b in batches:
            data, off = K.text_buffers(b.column(0))
            for lo, hi in K.chunks(off):
                h, q, size = _sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngram, sketch.value, bits, usual)
                size = size[size > 0]
                k1, kind = _identity(h, size, _C[2]), np.floor(np.log(size) / width + 1e-9).astype(np.uint8)
                prefix = size - _least_size(size, t) + 1 + np.floor(EXTRA * size + 1e-9).astype(np.int64)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                # a count of 1 is surely one text's own
                use = (pos < np.repeat(prefix, size)) & (q != 1)
                if use.any():
                    whose = np.repeat(np.arange(len(size)), size)[use]
                    held.append((K.mix(h[use]), k1[whose], kind[whose]))
                    n += len(whose)
                if n >= HELD:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    return run


def _ties(batches):
    """(k1, hub, c): c n-grams of a set's prefix are in others' too, of which the smallest is hub; from the rows of a part together."""

    def tied(h, k1, kind):
        h, k1, kind = (np.frombuffer(b"".join(x), t) for x, t in ((h, np.uint32), (k1, np.int64), (kind, np.uint8)))
        order = np.lexsort((kind, h))
        h, k1, kind = h[order], k1[order], kind[order]
        new = np.append(True, (h[1:] != h[:-1]) | (kind[1:].astype(np.int64) - kind[:-1] > 1))
        at = np.flatnonzero(new)
        hub, run = np.minimum.reduceat(k1, at), np.cumsum(new) - 1
        ok = (hub < np.maximum.reduceat(k1, at))[run]
        return k1[ok], hub[run[ok]], np.ones(int(ok.sum()), np.int64)

    def summed(found):
        k1, hub, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((hub, k1))
        k1, hub, c = k1[order], hub[order], c[order]
        at = np.flatnonzero((np.append(True, (k1[1:] != k1[:-1]) | (hub[1:] != hub[:-1]))) if len(k1) else [])
        return k1[at], hub[at], np.add.reduceat(c, at) if len(at) else c

    def send(found):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["k1", "hub", "c"])

    part, held, found = None, ([], [], []), []
    for b in batches:
        for now, *entries in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if now != part:
                if held[0]:
                    found.append(tied(*held))
                if sum(len(x[0]) for x in found) > 4 * HELD:
                    yield send(summed(found))
                    found = []
                part, held = now, ([], [], [])
            for x, e in zip(held, entries, strict=True):
                x.append(e)
    if held[0]:
        found.append(tied(*held))
    if found:
        yield send(summed(found))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members every two of these sorted sets have in common; the diagonal counts only what others have too."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    f, r = flat[order], row[order]
    new = np.ones(len(f), bool)
    new[1:] = f[1:] != f[:-1]
    code = np.cumsum(new) - 1
    twice = np.bincount(code) > 1
    keep = twice[code] if len(code) else np.zeros(0, bool)
    code, r = (np.cumsum(twice) - 1)[code[keep]], r[keep]
    inter = np.zeros((n, n))
    step = max(64, (1 << 20) // n)
    total = int(twice.sum())
    for lo in range(0, total, step):
        a, b = np.searchsorted(code, [lo, lo + step])
        m = np.zeros((n, min(step, total - lo)), np.float32)
        m[r[a:b], code[a:b] - lo] = 1
        inter += m @ m.T
    return inter


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard of every two of these sorted sets."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        inter = np.array([[size[0], both], [both, size[1]]], np.float64)
    else:
        inter = _shared(sets)
    return inter / np.maximum(size[:, None] + size[None, :] - inter, 1)


def _against(first: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard of one sorted set with each of these."""
    both = np.array([len(np.intersect1d(first, x, assume_unique=True)) for x in sets], np.float64)
    return both / (len(first) + np.array([len(x) for x in sets]) - both)


#: What a text takes along: its place (hub, two blocks), its own block, group, id and hash, its set, how many documents have that, its gatherings.
PLACED = ["hub", "i", "j", "block", "grp", "doc", "rid", "k1", "w", "places", "text"]


def _gatherings(ngram: int):
    """Turns batches of placed texts, in order of their places, into (place, [(doc, block, group, rid, k1, w, places, set)])."""

    def run(batches):
        place, held = None, {}
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(10)]
            data, off = K.text_buffers(b.column(10))
            for lo, hi in K.chunks(off):
                h, count = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngram)
                for k, part in zip(range(lo, hi), np.split(h, np.cumsum(count)[:-1]), strict=True):
                    now = (cols[0][k], cols[1][k], cols[2][k])
                    if now != place:
                        if held:
                            yield place, list(held.values())
                        place, held = now, {}
                    doc, rid = cols[5][k], cols[6][k]
                    if (doc, rid) not in held:
                        held[doc, rid] = (doc, cols[3][k], cols[4][k], rid, cols[7][k], cols[8][k], np.array(cols[9][k], np.int64), np.unique(part))
        if held:
            yield place, list(held.values())

    return run


def _emit(ids: np.ndarray, i: np.ndarray, j: np.ndarray, jac: np.ndarray):
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    a, b, jac = a[a < b], b[a < b], jac[a < b]
    for lo in range(0, len(a), 50_000):
        s = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(jac[s].astype(np.float64).round(6))], names=["doc_a", "doc_b", "jaccard"])


def _alike(ngram: int, least: float, batches):
    """(place, documents, their Jaccards, which two are alike, which of these count here)."""
    for (hub, one, other), docs in _gatherings(ngram)(batches):
        if len(docs) < 2:
            continue
        jac = _overlaps([d[7] for d in docs])
        alike = np.triu(jac >= least, 1)
        here = alike
        if one != other:
            block = np.array([d[1] for d in docs])
            here = here & (block[:, None] != block[None, :])
        # two that also meet in a smaller gathering count there
        before = [np.sort(d[6][d[6] < hub]) for d in docs]
        if here.any() and sum(len(x) > 0 for x in before) > 1:
            here = here & (_shared(before) == 0)
        yield hub, docs, jac, alike, here


def _verify(ngram: int, threshold: float, groups: bool):
    """Pairs of a gathering that are alike; with ``groups`` only between groups."""
    least = threshold - 1e-9

    def run(batches):
        for _, docs, jac, _, here in _alike(ngram, least, batches):
            if groups:
                grp = np.array([d[2] for d in docs])
                here = here & (grp[:, None] != grp[None, :])
            i, j = np.nonzero(here)
            if len(i):
                yield from _emit(np.array([d[0] for d in docs]), i, j, jac[i, j])

    return run


LINKS = "doc long, rid long, root long, n long"


def _verify_links(ngram: int, threshold: float):
    """For each set of a gathering that is alike with another: with how many documents, and the smallest one reached over such pairs."""
    least = threshold - 1e-9

    def run(batches):
        for _, docs, _, alike, here in _alike(ngram, least, batches):
            if not alike.any():
                continue
            ids, w = np.array([d[0] for d in docs]), np.array([d[5] for d in docs], np.int64)
            i, j = np.nonzero(here)
            n = np.bincount(np.concatenate([i, j]), np.concatenate([w[j], w[i]]).astype(np.float64), len(docs)).astype(np.int64)
            i, j = np.nonzero(alike)
            root = ids.copy()
            while True:
                low, was = np.minimum(root[i], root[j]), root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if np.array_equal(root, was):
                    break
            of = np.union1d(i, j)
            rid = np.array([d[3] for d in docs], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[of]) for x in (ids, rid, root, n)], names=["doc", "rid", "root", "n"])

    return run


def _verify_hub(ngram: int, threshold: float):
    """(hub's document, document) of a gathering's documents that are alike with the hub."""
    least = threshold - 1e-9

    def run(batches):
        for (hub, _, _), docs in _gatherings(ngram)(batches):
            rest = [d for d in docs if d[4] != hub]
            for first in [d for d in docs if d[4] == hub] if rest else []:
                ids = np.array([first[0], *(d[0] for d in rest)])
                jac = _against(first[7], [d[7] for d in rest])
                at = np.flatnonzero(jac >= least)
                yield from _emit(ids, np.zeros(len(at), np.int64), at + 1, jac[at])

    return run


PAIRS = "doc_a long, doc_b long, jaccard double"


class _Candidates:
    """The distinct n-gram sets of a table and which of them may be alike."""

    def __init__(self, docs: DataFrame, threshold: float, ngram: int, bits: int):
        bounded_batches(docs.sparkSession)
        t, self.threshold, self.ngram = threshold, threshold, ngram
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("rid")).where("doc is not null and text is not null")
        found = self.texts.mapInArrow(lean(_identities(ngram)), "doc long, rid long, k1 long, k2 long, n long")
        own = written(found.groupBy("k1", "k2", "doc").agg(F.min("rid").alias("rid"), F.min("n").alias("n")), "sets")
        first = own.groupBy("k1", "k2").agg(F.min(F.struct("doc", "rid")).alias("rep"), F.count("*").alias("w"))
        # who has which set; the smallest document with a set represents it
        self.members = written(own.join(first, ["k1", "k2"]).select("doc", F.col("rep.doc").alias("rep"), F.col("rep.rid").alias("rid"), "k1", "n", "w"), "members", instead_of=own)
        sketch = _sketch(self.texts.select("text"), _count(ngram, bits), bits + 1)
        entries = self.texts.select("text").mapInArrow(lean(_prefixes(ngram, t, sketch, bits, _usual(sketch.value, bits))), "part int, h binary, k1 binary, kind binary")
        ties = entries.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_ties), "k1 long, hub long, c long")
        ties = ties.groupBy("k1", "hub").agg(F.sum("c").alias("c")).join(self.members.where("doc = rep").select("doc", "rid", "k1", "w", "n"), "k1")
        # a partner may be as small as ceil(t n), and the smaller of two prefixes says how many n-grams they share
        least = 1 + F.floor(F.lit(EXTRA) * F.ceil(F.lit(t) * F.col("n") - 1e-9))
        # so each of two may leave out the hubs of fewer than half of these: one that both keep is left
        of = Window.partitionBy("doc", "rid")
        met = ties.withColumn("all", F.sum("c").over(of)).where(F.col("all") >= least).withColumn("upto", F.sum("c").over(of.orderBy("c", "hub").rowsBetween(Window.unboundedPreceding, 0)))
        met = written(met.where(2 * F.col("upto") > least - 1).select("doc", "rid", "k1", "w", F.col("hub").alias("at")), "met")
        live = met.groupBy("at").agg(F.min("k1").alias("hub"), F.max("k1").alias("last")).where("hub < last").select("at", "hub")
        self.tied = written(met.join(live, "at").groupBy("doc", "rid", "k1", "w").agg(F.collect_set("hub").alias("places")), "tied", instead_of=met)

    def placed(self, rows: DataFrame) -> DataFrame:
        """The texts of (hub, doc, rid, i, j, block, grp) rows, in order of their places; only those are shuffled."""
        rows = written(rows, "places")
        text = self.texts.where(may_be_in(F.col("doc"), key_filter(rows.select("doc"))))
        full = text.join(rows.join(self.tied, ["doc", "rid"]).hint("merge"), ["doc", "rid"]).select(*PLACED)
        return full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc")

    def gathered(self) -> DataFrame:
        """(hub, doc, rid, k1): who meets where."""
        return self.tied.select(F.explode("places").alias("hub"), "doc", "rid", "k1")

    def everyone(self) -> DataFrame:
        """The gatherings' texts, each with all others of its gathering."""
        met = self.gathered()
        sizes = met.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
        rows = met.join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("nb").cast("long")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        return self.placed(rows.select("hub", "doc", "rid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.lit(0).cast("long").alias("grp")))

    def pairs(self) -> DataFrame:
        """All pairs of distinct sets that are alike, by their representatives."""
        return self.everyone().mapInArrow(lean(_verify(self.ngram, self.threshold, False)), PAIRS)

    def links(self) -> DataFrame:
        """(doc, rid, root, n) of representatives: in each gathering, how many documents' sets are alike, and a document of the same class."""
        return self.everyone().mapInArrow(lean(_verify_links(self.ngram, self.threshold)), LINKS)

    def with_hubs(self) -> DataFrame:
        """Pairs of each document with its hubs that are alike."""
        met = self.gathered()
        sizes = met.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
        rows = met.join(sizes, "hub")
        own = F.when(F.col("k1") == F.col("hub"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("nb").cast("long")).cast("int")))
        rows = rows.select("hub", "doc", "rid", F.explode(own).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("grp"))
        return self.placed(rows).mapInArrow(lean(_verify_hub(self.ngram, self.threshold)), PAIRS)

    def between(self, group: DataFrame) -> DataFrame:
        """Pairs that are alike between different groups of (id, component); who is in none is a group of its own."""
        met = self.gathered().join(group.select(F.col("id").alias("doc"), "component"), "doc", "left").select("hub", "doc", "rid", "k1", F.coalesce("component", "doc").alias("grp"))
        # the hub's group is closed: in it no two need to meet
        per = met.groupBy("hub").agg(F.max(F.when(F.col("k1") == F.col("hub"), F.col("grp"))).alias("own"), F.count("*").alias("n"))
        met = met.join(per, "hub").withColumn("open", F.col("grp") != F.col("own"))
        open_ = met.where("open").groupBy("hub").agg(F.count("*").alias("m"))
        met = met.join(open_, "hub")
        half = F.lit(BLOCK // 2)
        met = met.withColumn("no", F.ceil(F.col("m") / half).cast("int")).withColumn("nc", F.ceil((F.col("n") - F.col("m")) / half).cast("int"))
        at = lambda c: F.pmod(F.xxhash64("doc"), F.greatest(F.col(c), F.lit(1)).cast("long")).cast("int")
        # open blocks are numbered from 0, closed ones from -1 down; open ones meet all, closed ones only open ones
        met = met.withColumn("block", F.when(F.col("open"), at("no")).otherwise(-1 - at("nc")))
        every = F.sequence(F.when(F.col("open"), -F.col("nc")).otherwise(F.lit(0)), F.col("no") - 1)
        rows = met.withColumn("other", F.explode(every))
        rows = rows.select("hub", "doc", "rid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "grp")
        return self.placed(rows).mapInArrow(lean(_verify(self.ngram, self.threshold, True)), PAIRS)


def join(docs: DataFrame, threshold: float = 0.6, ngram: int = 3, bits: int = 22) -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of documents whose n-gram sets are at least ``threshold`` alike, doc_a < doc_b; all of them.

    A set that several documents share is represented by the smallest of them.  There is a row for
    each other document with that set, paired with it (jaccard 1), and one for each two
    representatives of different sets that are alike.  So every document with a partner is in a row,
    and two documents are alike if their representatives are; copies cost a row each, not a row for
    each two of them.  ``links`` gives no rows for pairs.

    Null and empty texts have no n-grams and are in no pair, nor are rows without doc_id.  A text of
    fewer than n words has one n-gram.  Rows that share a doc_id are one document: it is paired if
    any of its texts is.  Very long texts are compared whole.  Other columns, whatever their names,
    are ignored.  An empty table gives no row.
    """
    c = _Candidates(docs, threshold, ngram, bits)
    same = c.members.where("doc <> rep").select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return c.pairs().unionAll(same).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def links(docs: DataFrame, threshold: float = 0.6, ngram: int = 3, bits: int = 22) -> DataFrame:
    """(doc_id, class_id, links): one row for every document, with the documents that are alike with it told and counted.

    ``links`` counts the documents whose n-gram sets are at least ``threshold`` alike with its own, copies
    included; all pairs of ``join`` and all copies are counted, none is written out.  ``class_id`` is the
    smallest doc_id that can be reached over such links; a document without any is a class of its own.

    Rows that share a doc_id are one row here, whose different sets are counted each: two that are alike are
    linked, and a partner of both counts twice.  Null and empty texts have no link.  Rows without doc_id are
    left out.  Other columns, whatever their names, are ignored.  An empty table gives no row.
    """
    c = _Candidates(docs, threshold, ngram, bits)
    found = written(c.links(), "links")
    edges = found.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionAll(c.members.select(F.col("doc").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    group = connected_components(edges, "a", "b").select(F.col("id").alias("doc_id"), "component")
    other = found.groupBy(F.col("doc").alias("rep"), "rid").agg(F.sum("n").alias("n"))
    count = c.members.drop("n").join(other, ["rep", "rid"], "left").groupBy(F.col("doc").alias("doc_id")).agg(F.sum(F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = every.join(group, "doc_id", "left").join(count, "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def deduplicate(docs: DataFrame, threshold: float = 0.6, ngram: int = 3, bits: int = 22) -> DataFrame:
    """docs without those that are alike: of each group of connected pairs (see ``join``) the smallest doc_id stays.

    Rows without doc_id or n-grams stay; rows that share a doc_id stay or go together; all columns,
    whatever their names, as they are.  An empty table stays empty.
    """
    c = _Candidates(docs, threshold, ngram, bits)
    same = c.members.where("doc <> rep").select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"))
    edges = written(c.with_hubs().select("doc_a", "doc_b").unionAll(same), "hub-pairs")
    group = written(connected_components(edges, "doc_a", "doc_b"), "groups")
    rest = written(c.between(group).select("doc_a", "doc_b"), "open-pairs")
    if not rest.isEmpty():
        # groups that such a pair connects are one
        of = lambda x: group.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
        more = rest.join(of("doc_a"), "doc_a", "left").join(of("doc_b"), "doc_b", "left").select(F.coalesce("c_doc_a", "doc_a").alias("doc_a"), F.coalesce("c_doc_b", "doc_b").alias("doc_b"))
        joined = written(connected_components(more, "doc_a", "doc_b"), "groups").select(F.col("id").alias("component"), F.col("component").alias("top"))
        whole = group.join(joined, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        alone = joined.join(group.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
        group = whole.unionAll(alone)
    gone = written(group.where("id <> component").select(F.col("id").alias("_gone")).distinct(), "gone")
    # only texts that may go are shuffled
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_gone"))
    row = row.withColumn("_hit", may_be_in(F.col("_gone"), key_filter(gone)))
    stay = row.where("not _hit").select("_row").unionAll(row.where("_hit").join(gone.hint("merge"), "_gone", "left_anti").select("_row"))
    return stay.select("_row.*")
