"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity; two sets as alike as the threshold
share a word among their rarest few (prefix filter), have sizes close to each other (length filter),
and the shared word's place bounds what can still be shared (positional filter).  A 64-bit parity
sketch of each set bounds the difference from below, so almost every pair that isn't alike is
dropped inside the join.  What is left is verified on the full sets.  Every filter is lossless: the
order of words may be any order, so rarity comes from a counting sketch of bounded size, built over
all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bounded_batches, key_filter, lean, may_be_in, passes, written

_C1 = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 18


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word in lower case."""
    low = K.lower(data)
    start, end = K.runs(~(K.SPACE[low] | (low == K.LINE_END)), off)
    return K.hash_ranges(low, start, end), start


def _parts(counts: np.ndarray):
    for i in range(0, len(counts), _PART):  # the last part may be shorter
        part = counts[i : i + _PART]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([_packed_part(part)], pa.binary())], names=["at", "part"])


def _packed_part(part: np.ndarray) -> bytes:
    """Size in bytes and compressed content."""
    return part.nbytes.to_bytes(4, "little") + pa.compress(part.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True), kind)


def _count(bits: int):
    def run(batches):
        counts, some = np.zeros(1 << bits, np.uint32), False
        for b in batches:
            data, off = K.text_buffers(b.column(0))
            for lo, hi in K.chunks(off):
                h, _ = _words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                some = some or len(h) > 0
        yield from _parts(counts if some else counts[:0])

    return run


def _merge(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = _unpacked(part, np.uint32).astype(np.float64)
            held[at] = held[at] + got if at in held else got
    for at, m in held.items():
        q = np.where(m > 0, np.minimum(np.round(8 * np.log2(np.maximum(m, 1))) + 1, 255), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed_part(q)], pa.binary())], names=["at", "part"])


def _sketch(column: DataFrame, count, bits: int):
    """Broadcast counts of 2**bits buckets, a byte each: 1 + 8 log2 of the bucket's count."""
    parts = column.mapInArrow(lean(count), "at long, part binary").repartition("at").mapInArrow(lean(_merge), "at long, part binary").toArrow()
    sketch = np.zeros(1 << bits, np.uint8)
    for at, part in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        sketch[at : at + _PART] = _unpacked(part, np.uint8)
    return column.sparkSession.sparkContext.broadcast(sketch)


def rarity(docs: DataFrame, bits: int = 24):
    """Sketch of all words' counts.  1 means that the bucket saw one word once: such a word is in one line only."""
    return _sketch(docs.select("text"), _count(bits), bits)


class _Sets:
    """The distinct words of each line of a chunk, rarest first."""

    def __init__(self, data: np.ndarray, off: np.ndarray, sketch: np.ndarray | None, bits: int):
        h, start = _words(data, off)
        ends = np.flatnonzero(data == K.LINE_END)
        # a line starts at each text's start and after each line end
        starts = np.union1d(off[:-1], ends + 1) if len(off) > 1 else np.zeros(0, np.int64)
        starts = starts[starts < len(data)]
        line = np.searchsorted(starts, start, "right") - 1
        q = sketch[(h >> np.uint64(64 - bits)).astype(np.int64)] if sketch is not None else np.zeros(len(h), np.uint8)
        low = h & np.uint64((1 << 36) - 1)
        if len(starts) <= 1 << 20:
            order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (q.astype(np.uint64) << np.uint64(36)) | low)
        else:  # the line doesn't fit the key's 20 bits; the order of words must be the same
            order = np.lexsort((h, low, q, line))
        h, q, line = h[order], q[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.q, line = h[new], q[new], line[new]
        used, self.size = np.unique(line, return_counts=True)
        self.at = np.cumsum(self.size) - self.size
        begin = starts[used]
        self.text = np.searchsorted(off, begin, "right") - 1
        before = np.searchsorted(ends, np.stack([begin, off[self.text]]))
        self.number = (before[0] - before[1]).astype(np.int32)
        if len(used):
            self.k1 = np.add.reduceat(K.mix(self.h ^ _C1), self.at).view(np.int64)
            self.parity = np.bitwise_xor.reduceat(np.uint64(1) << (self.h >> np.uint64(58)), self.at).view(np.int64)
        else:
            self.k1 = self.parity = np.zeros(0, np.int64)


def _lists(counts: np.ndarray, flat) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def _line_rows(sketch, bits: int, t: float):
    names = ["k1", "doc", "rid", "line", "n", "parity", "prefix"]

    def run(batches):
        for b in batches:
            doc, rid = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, off = K.text_buffers(b.column(2))
            parts = []
            for lo, hi in K.chunks(off):
                s = _Sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], sketch.value, bits)
                if len(s.size):
                    probe = s.size - np.ceil(t * s.size - 1e-9).astype(np.int64) + 1
                    pos = np.arange(len(s.h)) - np.repeat(s.at, s.size)
                    use = (pos < np.repeat(probe, s.size)) & (s.q != 1)
                    packed = ((s.h[use] >> np.uint64(16)) << np.uint64(16)) | np.minimum(pos[use], 0xFFFF).astype(np.uint64)
                    count = np.add.reduceat(use.astype(np.int64), s.at)
                    parts.append((s.k1, s.text + lo, s.number, s.size, s.parity, count, packed.view(np.int64)))
            if not parts:
                continue
            k1, text, number, size, parity, count, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
            d = doc[text]
            # map-side combine: of equal sets in a batch only the first goes on whole; the others' prefixes are left out
            order = np.lexsort((number, text, d, size, parity, k1))
            again = np.zeros(len(k1), bool)
            again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (parity[order[1:]] == parity[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
            # under one doc_id an equal line is a copy only within the same text
            heads = order[np.flatnonzero(~again[order])]
            lead = np.empty(len(k1), np.int64)
            lead[order] = heads[np.cumsum(~again[order]) - 1]
            again &= (d != d[lead]) | (text == text[lead])
            prefix = _lists(np.where(again, 0, count), pa.array(packed[np.repeat(~again, count)]))
            copy = pa.array(again)
            cols = [pa.array(k1), pa.array(d), pa.array(rid[text]), pa.array(number), pa.array(size.astype(np.int32)), pa.array(parity), prefix, copy]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "copy"])

    return run


def _needed_sets(filt, bits: int):
    held, fbits = filt

    def run(batches):
        for b in batches:
            doc, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = K.text_buffers(b.column(2))
            for lo, hi in K.chunks(off):
                s = _Sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], None, bits)
                ok = passes(held.value, fbits, (doc[s.text + lo] << 20) ^ s.number)
                if ok.any():
                    at = s.text[ok] + lo
                    h, size = s.h[np.repeat(ok, s.size)], s.size[ok]
                    cols = [pa.array(doc[at]), pa.array(rid[at]), pa.array(s.number[ok]), pa.array(size.astype(np.int32)), _lists(size, pa.array(h.view(np.int64))), _lists(size, pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))]
                    first, bit = np.cumsum(size) - size, np.uint64(1) << (h >> np.uint64(50) & np.uint64(63))
                    part = h >> np.uint64(56) & np.uint64(3)
                    for i in range(4):
                        cols.append(pa.array(np.bitwise_xor.reduceat(np.where(part == np.uint64(i), bit, np.uint64(0)), first).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "rid", "line", "n", "words", "halves", "s0", "s1", "s2", "s3"])

    return run


def _place(doc: str, line: str):
    """One long for a line's place; places that share it only cost time."""
    return F.shiftleft(F.col(doc), 20).bitwiseXOR(F.col(line).cast("long"))


def removals(docs: DataFrame, threshold: float = 0.8, bits: int = 24) -> DataFrame:
    """(doc, rid, lines): the 0-based numbers of the lines to take out of each text that has any; rid is the text's hash."""
    bounded_batches(docs.sparkSession)
    t = threshold
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text")).where("text is not null")
    sketch = rarity(src, bits)
    rows = src.mapInArrow(lean(_line_rows(sketch, bits, t)), "k1 long, doc long, rid long, line int, n int, parity long, prefix array<long>, copy boolean")
    # equal sets are told by two hashes and the size
    first = Window.partitionBy("k1", "parity", "n").orderBy("doc", "copy", "rid", "line").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("f", F.first(F.struct("doc", "rid", "line")).over(first))
    later = F.col("copy") | (F.col("doc") > F.col("f.doc")) | ((F.col("rid") == F.col("f.rid")) & (F.col("line") > F.col("f.line")))
    is_first = (F.col("doc") == F.col("f.doc")) & (F.col("rid") == F.col("f.rid")) & (F.col("line") == F.col("f.line"))
    lines = written(ranked.select("doc", "rid", "line", "n", "parity", F.when(is_first, F.col("prefix")).alias("prefix"), later.alias("later")), "lines")
    kept = lines.where("prefix is not null")

    entry = (
        kept.select("doc", "parity", "line", "n", F.explode("prefix").alias("e"))
        # line and size in one long; the place is a bound from below, so 16 bits do for any line
        .select(F.shiftright("e", 16).alias("tok"), "doc", "parity", F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("p"), F.col("e").bitwiseAND(0xFFFF).cast("int").alias("pos"))
    )
    side = lambda x: entry.select("tok", *(F.col(c).alias(f"{x}_{c}") for c in ("doc", "parity", "pos")), F.shiftright("p", 32).cast("int").alias(f"{x}_line"), F.col("p").bitwiseAND(2**32 - 1).cast("int").alias(f"{x}_n"))
    x, y = side("x"), side("y")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    alike = (
        # each pair once: x comes earlier
        ((F.col("x_doc") < F.col("y_doc")) | ((F.col("x_doc") == F.col("y_doc")) & (F.col("x_line") < F.col("y_line"))))
        & (F.least("x_n", "y_n") >= F.ceil(F.lit(t) * F.greatest("x_n", "y_n") - 1e-9))
        & (F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity"))) <= F.col("x_n") + F.col("y_n") - 2 * need)
        & (F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= need)
    )
    pairs = x.join(y.hint("merge"), "tok").where(alike)
    pairs = written(pairs.select(F.col("x_doc").alias("a"), F.col("x_line").alias("al"), F.col("y_doc").alias("b"), F.col("y_line").alias("bl")).distinct(), "line-pairs")

    filt = key_filter(pairs.select(_place("a", "al").alias("k")).unionAll(pairs.select(_place("b", "bl").alias("k"))))
    sets = written(src.mapInArrow(lean(_needed_sets(filt, bits)), "doc long, rid long, line int, n int, words array<long>, halves array<int>, s0 long, s1 long, s2 long, s3 long"), "line-sets")

    # A wide parity sketch bounds the difference of a pair closely: what it leaves is alike, or nearly.
    sk = lambda x: sets.select(F.col("doc").alias(x), F.col("line").alias(f"{x}l"), F.col("n").alias(f"{x}n"), *(F.col(f"s{i}").alias(f"{x}{i}") for i in range(4)))
    wide = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    most = F.col("an") + F.col("bn") - 2 * F.ceil(F.lit(t / (1 + t)) * (F.col("an") + F.col("bn")) - 1e-9)
    pairs = pairs.join(sk("b"), ["b", "bl"]).join(sk("a"), ["a", "al"]).withColumn("d", wide.cast("int")).where(F.col("d") <= most)
    pairs = written(pairs.select("a", "al", "b", "bl", "d").distinct(), "line-close")

    # A line goes if any earlier line is alike, so each is first verified against its closest candidate,
    # on half of each word's hash; what that leaves open meets all its candidates on the whole hashes.
    best = pairs.groupBy("b", "bl").agg(F.min(F.struct("d", "a", "al")).alias("m")).select("b", "bl", F.col("m.a").alias("a"), F.col("m.al").alias("al"))
    settled = written(_verified(best, sets, t, "halves", 1), "line-settled")
    open_ = written(pairs.drop("d").join(settled.select(F.col("doc").alias("b"), F.col("line").alias("bl")), ["b", "bl"], "left_anti"), "line-open")
    near = key_filter(open_.select(_place("a", "al").alias("k")).unionAll(open_.select(_place("b", "bl").alias("k"))))
    rest = _verified(open_, sets.where(may_be_in(_place("doc", "line"), near)), t, "words", 0)
    gone = lines.where("later").select("doc", "rid", "line").unionAll(settled).unionAll(rest)
    return written(gone.groupBy("doc", "rid").agg(F.collect_set("line").alias("lines")), "line-removals")


def _verified(pairs: DataFrame, sets: DataFrame, t: float, words: str, spare: int) -> DataFrame:
    """(doc, rid, line) of the later lines of the pairs that share ``spare`` words more than they must.

    Halves of hashes may take two different words for one, once in some 10**8 pairs; with one word
    to spare that would have to happen twice in a pair, which is as rare as equal whole hashes.
    """
    a = sets.select(F.col("doc").alias("a"), F.col("line").alias("al"), F.col("rid").alias("ar"), F.col(words).alias("wa"))
    b = sets.select(F.col("doc").alias("b"), F.col("line").alias("bl"), F.col("rid").alias("br"), F.col(words).alias("wb"))
    both = F.size(F.array_intersect("wa", "wb")) - spare
    # within one doc_id only lines of the same text
    fair = (F.col("a") != F.col("b")) | (F.col("ar") == F.col("br"))
    close = pairs.join(b, ["b", "bl"]).join(a, ["a", "al"]).where(fair & (both >= F.lit(t) * (F.size("wa") + F.size("wb") - both) - 1e-9))
    return close.select(F.col("b").alias("doc"), F.col("br").alias("rid"), F.col("bl").alias("line"))


def clean(docs: DataFrame, threshold: float = 0.8, bits: int = 24, drop_emptied: bool = True, count_as: str | None = None) -> DataFrame:
    """docs without the lines that are at least ``threshold`` alike (Jaccard of their word sets) to an earlier line.

    Lines end at a line feed; words are what white space parts, in lower case.  Earlier means a
    smaller doc_id, or a smaller line number in the same text; an earlier line counts even if it is
    itself taken out.  Lines without words are left alone.  ``n_chars``, if there, follows the text.
    ``count_as`` names a further column
    for the number of lines taken out.  With ``drop_emptied`` a document none of whose words is left goes; one that had none before stays.

    Null and empty texts stay as they are.  Rows without doc_id come last.  Rows that share a doc_id
    but not the text don't take lines from each other; repeated rows are treated alike.  A line of
    any length is compared whole.  Other columns, whatever their names, are passed on.
    """
    gone = removals(docs, threshold, bits)
    filt = key_filter(gone.select("doc"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), may_be_in(doc, filt).alias("_hit"), doc.alias("_doc"))
    same = tagged.where("not _hit").select("_row")
    touched = tagged.where("_hit").select("_row", "_doc", F.xxhash64("_row.text").alias("_rid"))
    hit = touched.join(gone.select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"), F.col("lines").alias("_lines")), ["_doc", "_rid"], "left")
    text = F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda _, i: ~F.array_contains("_lines", i)), "\n")
    hit = hit.withColumn("_text", F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(text))
    if drop_emptied:
        hit = hit.where(F.col("_lines").isNull() | F.col("_text").rlike(r"[^ \t\r\n\x0B\f]"))
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_lines").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType)))
    taken = F.coalesce(F.greatest(F.size("_lines"), F.lit(0)), F.lit(0)) if count_as else F.lit(0)
    both = same.select("_row", F.lit(0).alias("_taken")).unionAll(hit.select(row.alias("_row"), taken.alias("_taken")))
    return both.select("_row.*", *([F.col("_taken").alias(count_as)] if count_as else []))


#: The same over DuckDB: exact rarity instead of the sketch, which changes no result.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS rid, i - 1 AS line, parts[i] AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(lower(s), '[ \t\r\x0B\f]+'), lambda x: x <> ''))) AS w FROM lines),
keyed AS (
  SELECT w, min(struct_pack(d := doc_id, l := line)) AS f FROM sets WHERE len(w) > 0 GROUP BY w),
ids AS (SELECT row_number() OVER (ORDER BY f) AS id, w, f, len(w) AS n FROM keyed),
toks AS (SELECT id, n, unnest(w) AS t FROM ids),
df AS (SELECT t, count(*) AS c FROM toks GROUP BY t),
pre AS (
  SELECT id, n, t FROM (
    SELECT id, n, toks.t, row_number() OVER (PARTITION BY id ORDER BY c, toks.t) AS r FROM toks JOIN df ON toks.t = df.t)
  WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
near AS (
  SELECT DISTINCT c.b FROM cand c JOIN ids x ON x.id = c.a JOIN ids y ON y.id = c.b
  WHERE len(list_intersect(x.w, y.w)) >= 0.8 * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
gone AS (
  SELECT s.doc_id, s.line FROM sets s JOIN ids i ON s.w = i.w
  WHERE i.f <> struct_pack(d := s.doc_id, l := s.line) OR i.id IN (SELECT b FROM near)),
per AS (SELECT doc_id, list(line) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(g), 0) AS INTEGER) AS removed,
  CASE WHEN g IS NULL THEN d.text ELSE coalesce(array_to_string(
    list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(g, i - 1)), lambda i: string_split(d.text, chr(10))[i]), chr(10)), '') END AS text
FROM documents d LEFT JOIN per USING (doc_id)
"""


def report(docs: DataFrame, threshold: float = 0.8, bits: int = 24) -> DataFrame:
    """(doc_id, removed, text) of every row of docs: how many lines go and what is left, by the rules of ``clean``; an emptied text is ''."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return clean(slim, threshold, bits, drop_emptied=False, count_as="removed")
