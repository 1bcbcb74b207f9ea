"""SentencePiece encoding and decoding that keeps each piece's place in the original bytes.

Normalisation is longest-prefix replacement through the model's compiled character map (a
double-array trie), or through another one that the caller passes; it records, for each normalised
byte, the original byte it came from, so every piece projects to a span of the original text.  The
trie is walked for all places of a chunk in step, and the alignment is one array.

No piece holds a space sign after another sign, and some signs are in no piece at all: merges never
cross such places.  A text is therefore cut there, each distinct segment is encoded once per
worker, and the ids are the same as those of the whole text.
"""

from __future__ import annotations

import hashlib
import functools
import itertools
import os
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import bounded_batches, lean

SPACE = "▁"
#: Segments a worker remembers before it starts anew.
CACHE = 300_000
#: Bytes encoded at a time; a longer text is encoded whole.
PART = 1 << 18


def default_model() -> str:
    """Place of the public vocabulary; callers pass another path to use another one."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


class CharsMap:
    """The compiled character map: uint32 size of the trie, the trie's units, the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.strings = blob[4 + size :]

    def _arrays(self):
        """Units as an array, and which first bytes, alone or with the next one, may begin a key."""
        if not hasattr(self, "_held"):
            self._held = (np.array(self.units, np.uint32), np.ones(1 << 16, bool), np.zeros(256, bool))
            pair = np.arange(1 << 16, dtype=np.uint16).astype(">u2").view(np.uint8)
            begin = np.arange(1 << 16) * 2
            _, _, deep = self._walk(pair, begin, begin + 2)
            size, _, _ = self._walk(np.arange(256, dtype=np.uint8), np.arange(256), np.arange(256) + 1)
            self._held = (self._held[0], deep, size > 0)
        return self._held

    def _walk(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes matched or 0, place of the replacement, whether the second byte fits too) of the longest key at each place."""
        units = self._held[0]
        size, value, deep = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        live, step = np.arange(len(at)), 0
        down = lambda u: (u >> np.uint32(10)) << ((u & np.uint32(0x200)) >> np.uint32(6))
        node = np.full(len(at), down(units[0]), np.uint32)
        while True:
            go = at[live] + step < end[live]
            live, node = live[go], node[go]
            if not len(live):
                return size, value, deep
            sign = data[at[live] + step].astype(np.uint32)
            node = node ^ sign
            u = units[np.minimum(node, len(units) - 1)]
            fits = (node < len(units)) & (u & np.uint32(0x800000FF) == sign)
            live, node, u = live[fits], node[fits], u[fits]
            node = node ^ down(u)
            leaf = np.flatnonzero(u >> np.uint32(8) & np.uint32(1))
            size[live[leaf]], value[live[leaf]] = step + 1, units[node[leaf]] & np.uint32(0x7FFFFFFF)
            if step == 1:
                deep[live] = True
            step += 1

    def matches(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, bytes matched, places of the replacements) that one longest match after another covers, over valid UTF-8 texts."""
        _, deep, short = self._arrays()
        pair = data.astype(np.uint16) << np.uint16(8)
        pair[:-1] |= data[1:]
        at = np.flatnonzero((deep[pair] | short[data]) & (data & 0xC0 != 0x80))
        size, value, _ = self._walk(data, at, off[np.searchsorted(off, at, "right")])
        at, size, value = at[size > 0], size[size > 0], value[size > 0]
        if len(at) and (at[1:] < at[:-1] + size[:-1]).any():
            take, free = np.ones(len(at), bool), 0
            for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                if a < free:
                    take[i] = False
                else:
                    free = a + n
            at, size, value = at[take], size[take], value[take]
        return at, size, value

    def replacements(self) -> tuple[np.ndarray, np.ndarray]:
        """The replacements' bytes and where each of them ends."""
        text = np.frombuffer(self.strings, np.uint8)
        return text, np.flatnonzero(text == 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key at this place."""
        u = self.units[0]
        node, best = (u >> 10) << ((u & 0x200) >> 6), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            u = self.units[node]
            if u & 0x800000FF != data[i]:
                break
            node ^= (u >> 10) << ((u & 0x200) >> 6)
            if u >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1] : end]


@dataclass
class Model:
    """What workers need: the model without its own normalisation, and its rules apart."""

    proto: bytes
    charsmap: bytes
    dummy_prefix: bool
    trim: bool

    def key(self) -> bytes:
        """Differs between any two models that encode differently."""
        return hashlib.sha256(b"%d %d %d " % (self.dummy_prefix, self.trim, len(self.proto)) + self.proto + self.charsmap).digest()

    @classmethod
    def load(cls, path: str, charsmap: bytes | None = None) -> Model:
        """The model of a file; ``charsmap`` takes the place of its own map."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        got = (bytes(spec.precompiled_charsmap) if charsmap is None else charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        if m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only models that mark the start of words are supported")
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        return cls(m.SerializeToString(), *got)


def compile_map(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map of {key: replacement}: a double-array trie and the replacements."""
    strings, at = bytearray(), {}
    tree: dict = {}
    for key, to in rules.items():
        if to not in at:
            at[to] = len(strings)
            strings += to + b"\0"
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[None] = at[to]
    units, used, bases, free, todo = {0: 0}, {0}, set(), 1, [(0, tree)]
    for pos, node in todo:  # grows as it goes
        labels = sorted(0 if c is None else c for c in node)
        while free in used:
            free += 1
        slot = free
        while slot in used or (base := slot ^ (labels[0] if labels else 0)) in bases or any(base ^ c in used for c in labels):
            slot += 1
        bases.add(base)
        for c, child in node.items():
            place = base ^ (c or 0)
            used.add(place)
            units[place] = child | 1 << 31 if c is None else c
            if c is not None:
                todo.append((place, child))
        # children are found by xor with the node's own place
        units[pos] |= (pos ^ base) << 10 | (1 << 8 if None in node else 0)
    if max(units) >= 1 << 21:
        raise ValueError("too many keys for one map")
    flat = np.full(max(units) + 256, 0xFF, "<u4")
    flat[list(units)] = list(units.values())
    return flat.nbytes.to_bytes(4, "little") + flat.tobytes() + bytes(strings)


@functools.cache
def nfkc_map() -> bytes:
    """Unicode's compatibility composition: of single signs, and of base signs and half-width kana with their marks (not of Hangul's letters)."""
    rules = {}
    for i in itertools.chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        c = chr(i)
        to = unicodedata.normalize("NFKC", c)
        if to != c:
            rules[c.encode()] = to.encode()
        if not 0xAC00 <= i <= 0xD7A3:
            apart = unicodedata.normalize("NFD", c)
            if len(apart) > 1 and unicodedata.normalize("NFKC", apart) == to:
                rules[apart.encode()] = to.encode()
    for kana, mark in itertools.product(range(0xFF66, 0xFF9E), "\uff9e\uff9f"):
        to = unicodedata.normalize("NFKC", chr(kana) + mark)
        if len(to) == 1:
            rules[(chr(kana) + mark).encode()] = to.encode()
    return compile_map(rules)


def normalised(data: np.ndarray, off: np.ndarray, charsmap: CharsMap | None, trim: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(bytes, offsets, alignment) of a chunk of valid UTF-8 texts, by the rules of ``normalise``.

    Text i's alignment starts at its offset + i and has a place more than the text has bytes; it is
    None where no byte moved.
    """
    n = len(off) - 1
    at, size, value = charsmap.matches(data, off) if charsmap and len(data) else (np.zeros(0, np.int64),) * 3
    if not len(at) and not trim:
        return data, off, None
    kind = np.int32 if len(data) < 1 << 28 else np.int64  # a replacement may be longer than its key
    place = np.arange(len(data), dtype=kind)
    if len(at):
        text, ends = charsmap.replacements()
        length = ends[np.searchsorted(ends, value)] - value
        gone = np.zeros(len(data) + 1, np.int8)
        gone[at] += 1
        gone[at + size] -= 1
        kept = np.cumsum(gone[:-1], dtype=np.int8) == 0
        count = kept.astype(kind)
        count[at] = length
        stop = np.cumsum(count, dtype=kind)
        out, place = np.empty(int(stop[-1]), np.uint8), np.empty(int(stop[-1]), kind)
        to = (stop - count)[kept]
        out[to], place[to] = data[kept], np.flatnonzero(kept)
        flat = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        to = np.repeat((stop - count)[at], length) + flat
        out[to], place[to] = text[np.repeat(value, length) + flat], np.repeat(at, length)
        noff = np.append(stop, 0)[off - 1].astype(np.int64)
        noff[off == 0] = 0
    else:
        out, noff = data, off.astype(np.int64)
    last = np.diff(off).astype(np.int64)  # where each text's alignment ends
    if trim and len(out):
        space = out == 32
        first = np.zeros(len(out), bool)
        first[noff[:-1][np.diff(noff) > 0]] = True
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        keep &= ~(space & first)
        # a kept space that nothing but spaces follow goes as well; there the text ends
        run = np.flatnonzero(keep & space)
        if len(run):
            text = np.searchsorted(noff, run, "right") - 1
            sign = np.flatnonzero(~space)
            after = np.searchsorted(sign, run)
            ends = (after == len(sign)) | (np.append(sign, 0)[np.minimum(after, len(sign))] >= noff[text + 1])
            last[text[ends]] = place[run[ends]] - off[text[ends]]
            keep[run[ends]] = False
        # a text of spaces only ends where it began to be one
        sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), noff[:-1]) * (np.diff(noff) > 0)
        out, place, noff = out[keep], place[keep], np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n, dtype=kind), np.diff(noff))
    align = np.empty(len(out) + n, kind)
    align[np.arange(len(out), dtype=kind) + owner] = place - off.astype(kind)[owner]
    align[noff[1:] + np.arange(n)] = last
    return out, noff, align


def normalise(data: bytes, charsmap: CharsMap | None, trim: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes (spaces still spaces) and, for each of them and the end, the original byte.

    A replacement's bytes all come from the start of what it replaced; an invalid byte becomes
    U+FFFD.  With ``trim``, spaces at the ends go and runs of them become one.
    """
    out, src, at, n = bytearray(), [], 0, len(data)
    while at < n:
        hit = charsmap.longest(data, at) if charsmap else None
        if hit is None:
            c = data[at]
            size = 1 if c < 0x80 else 2 if c >> 5 == 6 else 3 if c >> 4 == 14 else 4 if c >> 3 == 30 else 0
            part = data[at : at + size]
            ok = size and len(part) == size and all(x >> 6 == 2 for x in part[1:])
            hit = (size, part) if ok else (1, b"\xef\xbf\xbd")
            places = range(at, at + size) if ok else [at] * 3
        else:
            places = [at] * len(hit[1])
        for b, p in zip(hit[1], places, strict=True):
            if trim and b == 32 and (not out or out[-1] == 32):
                continue
            out.append(b)
            src.append(p)
        at += hit[0]
    end = n
    while trim and out and out[-1] == 32:
        out.pop()
        end = src.pop()
    return bytes(out), np.array([*src, end], np.int64)


class Encoder:
    """A worker's processor with the segments it has already encoded."""

    def __init__(self, model: Model):
        import sentencepiece

        self.model = model
        self.map = CharsMap(model.charsmap) if model.charsmap else None
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.unk = sp.unk_id()
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: Bytes of each piece, then the same without the added space, for a text's first piece.
        self.raw = pa.array([*raw, *(x[1:] if x[:1] == b" " else x for x in raw)], pa.large_binary())
        self.size = np.array([len(x) for x in raw], np.int32)
        normal = [p for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)]
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("the vocabulary has pieces that span words")
        inside = set("".join(normal))
        #: ASCII signs that are in no piece: always apart.
        self.alone = np.zeros(256, bool)
        self.alone[[c for c in range(128) if chr(c) not in inside and c != 32]] = True
        self._forget()

    def _forget(self) -> None:
        #: Hashes of the segments encoded so far, ascending, and where their ids are.
        self.known, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, segments: list[str]) -> None:
        got = self.sp.encode(segments)
        counts = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.int32, int(counts.sum()))
        sizes = self.size[flat]
        if (flat == self.unk).any():
            texts = [s for x in self.sp.encode(segments, out_type=str) for s in x]
            for j in np.flatnonzero(flat == self.unk):
                sizes[j] = len(texts[j].replace(SPACE, " ").encode())
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.place = np.insert(self.place, at, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.ids, self.sizes = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, sizes])

    def encode(self, data: np.ndarray, off: np.ndarray, spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(pieces of each text, ids, starts, ends) of a chunk of texts; places are bytes of the original text, None without ``spans``."""
        n, aligned = len(off) - 1, None
        if not _valid(data):
            parts = [normalise(data[off[i] : off[i + 1]].tobytes(), self.map, self.model.trim) for i in range(n)]
            aligned = np.concatenate([a for _, a in parts])
            sizes = np.array([len(p) for p, _ in parts], np.int64)
            data, off = np.frombuffer(b"".join(p for p, _ in parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        elif self.map or self.model.trim:
            data, off, aligned = normalised(data, off, self.map, self.model.trim)
        if not len(data):
            z = np.zeros(0, np.int64)
            return np.zeros(n, np.int64), z.astype(np.int32), z, z
        space = data == 32
        cut = np.zeros(len(data), bool)
        cut[0] = True
        cut[1:] = space[1:] & ~space[:-1]
        alone = self.alone[data]
        cut |= alone
        cut[1:] |= alone[:-1]
        begin = off[:-1][np.diff(off) > 0]
        cut[begin] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first = np.zeros(len(data), bool)
        first[begin] = self.model.dummy_prefix
        first = first[starts]
        keys = K.hash_ranges(data, starts, ends) ^ (first.astype(np.uint64) << np.uint64(63))
        uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > CACHE:
            self._forget()
        at = np.searchsorted(self.known, uniq)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            raw = data.tobytes()
            s, e, f = (x[where[new]].tolist() for x in (starts, ends, first))
            self._learn(uniq[new], [(SPACE if x else "") + raw[a:b].decode().replace(" ", SPACE) for a, b, x in zip(s, e, f, strict=True)])
            at = np.searchsorted(self.known, uniq)
        back = at[back.reshape(-1)]
        counts = self.count[back]
        total = int(counts.sum())
        seg_at = np.cumsum(counts) - counts
        take = np.arange(total) + np.repeat(self.place[back] - seg_at, counts)
        ids = self.ids[take]
        per = np.bincount(np.searchsorted(off, starts, "right") - 1, weights=counts, minlength=n).astype(np.int64)
        if not spans:
            return per, ids, None, None
        size = self.sizes[take].astype(np.int64)
        size[seg_at[first]] -= 1  # the added space is nowhere in the text
        stop = np.cumsum(size)
        start = stop - size
        base = np.repeat(off[:-1], per)
        start, stop = start - base, stop - base
        if aligned is not None:
            base = np.repeat(off[:-1] + np.arange(n), per)
            start, stop = aligned[base + start], aligned[base + stop]
        return per, ids, start, stop

    def decode(self, per: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Normalised bytes of each text from its ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is outside the vocabulary")
        ids = ids.astype(np.int64)
        if self.model.dummy_prefix:
            ids[(np.cumsum(per) - per)[per > 0]] += len(self.size)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int64()), self.raw.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


_encoders: dict[bytes, Encoder] = {}


def encoder(model: Model) -> Encoder:
    """This process's encoder of the model."""
    key = model.key()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("starts", T.ArrayType(T.IntegerType(), False)),
    T.StructField("ends", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.IntegerType()), T.StructField("lossless", T.BooleanType()),
])


def _list(per: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, model_file: str | None = None, charsmap: bytes | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, n_pieces, lossless) for every row of docs.

    Piece i of a text covers its bytes starts[i]:ends[i] (UTF-8, 0-based); the space that the model
    adds at the start covers none.  ``lossless``: decoding the ids gives the text back byte for
    byte; a map that rewrites signs makes it false for the texts it rewrites.  The map is the model's
    own, or ``charsmap``: see ``nfkc_map`` for one of Unicode's.  A null or empty text
    has empty lists and is lossless.  Long texts are encoded whole.  Rows are encoded one by one:
    repeated rows give equal rows, a null doc_id stays null, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Model.load(model_file or default_model(), charsmap))

    def run(batches):
        enc = encoder(held.value)
        for b in batches:
            data, off = K.text_buffers(b.column(1))
            for lo, hi in K.chunks(off, PART):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                per, ids, start, stop = enc.encode(part, o)
                same = pc.equal(enc.decode(per, ids), K.column(b.column(1).slice(lo, hi - lo)).cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _list(per, ids), _list(per, start), _list(per, stop), pa.array(per.astype(np.int32)), same], names=RESULT.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), RESULT)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids): the normalised text.

    Null or empty ids give an empty text; ids outside the vocabulary raise an error; null ids within a
    list are skipped; bytes that aren't UTF-8 become U+FFFD.  Other columns, whatever their names,
    are ignored; repeated rows give equal rows; an empty table gives none.
    """
    held = encoded.sparkSession.sparkContext.broadcast(Model.load(model_file or default_model()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        enc = encoder(held.value)
        for b in batches:
            lists = b.column(1).to_pylist()
            lists = [[i for i in x or [] if i is not None] for x in lists]
            per = np.array([len(x) for x in lists], np.int64)
            out = enc.decode(per, np.array([i for x in lists for i in x], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode(errors="replace") for x in out.to_pylist()], pa.string())], names=schema.names)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), schema)
