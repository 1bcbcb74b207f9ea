"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel compares two words by the subsequences of three signs that they share, each weighted by
``DECAY`` to the power of the places it spans, so an insult still matches with gaps, inserted signs
or signs left out.  Spans reach over ``SPAN`` places at most, which makes a word's features few and
explicit: the machine's weights over landmarks fold into one table, and scoring a word costs a
gather per pair of gaps, whatever the number of landmarks.

Training follows the multiple-instance scheme: a document labelled toxic is a bag of words of which
some are to blame, the words of clean documents give negatives, and the machine and the choice of
each toxic bag's witness word alternate.

What no single word shows lies in several words or in how often they occur.  Words and gapped pairs
of words within a sentence that occur at a higher rate in toxic documents are terms with a weight;
the evidence of terms and words is summed over each sentence and over the whole text, and measured
against what clean text of that length holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import bounded_batches, bounded_sample, lean
from .svm import fit_dense_svm

DECAY, SPAN = 0.8, 7
#: Subsequences are hashed into so many buckets.
BITS = 16
DIM = 1 << BITS
START, END = 62, 63
#: Words of a pair are at most so many places apart.
APART = 2
#: Levels of words' scores, each with evidence of its own; below the first there is none.
LEVELS = np.array([-0.4, 0.0, 0.4, 0.8, 1.2, 1.6])
#: Added to the variance of a sum of evidence, so a short text needs more than chance.
LEAST_VAR = 1.0
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]

#: Sign of each byte: 255 parts words, 254 is left out of them.  Figures and signs that stand for letters become them.
SIGN = np.full(256, 254, np.uint8)
SIGN[97:123] = np.arange(26)
for _b, _c in zip(b"0134578@$!", b"oieastbasi", strict=True):
    SIGN[_b] = _c - 97
SIGN[[9, 10, 11, 12, 13, 32]] = 255
#: These end a sentence before white space; a line end always does.
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: Continuation bytes of two-byte letters: 36 further signs; lead bytes are left out.
SIGN[128:192] = 26 + np.arange(64) % 36


def _bucket(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (((x.astype(np.uint32) << np.uint32(12)) | (y.astype(np.uint32) << np.uint32(6)) | z) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class Words:
    """Distinct words of a chunk: their signs end to end (with start and end marks) and lengths."""

    signs: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    #: Distinct word of each word in the chunk, and the text it's in.
    which: np.ndarray
    text: np.ndarray
    #: Hash of each distinct word, and number of the sentence of each word in the chunk.
    key: np.ndarray | None = None
    sentence: np.ndarray | None = None

    def name(self, i: int) -> bytes:
        return self.signs[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def only(self, ids: np.ndarray) -> Words:
        """The distinct words of these numbers."""
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        flat = np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(self.starts[ids], size)
        return Words(self.signs[flat], at, size, self.which[:0], self.text[:0])


def _of_names(names: list[bytes]) -> Words:
    size = np.array([len(x) for x in names], np.int64)
    none = np.zeros(0, np.int64)
    return Words(np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size, size, none, none)


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """Words between white space, stripped of signs; runs of one-letter words count as one word."""
    sign = SIGN[K.lower(data)]
    kept = np.flatnonzero(sign != 254)
    s = sign[kept]
    o = np.searchsorted(kept, off)
    start, end = K.runs(s != 255, o)
    text = np.searchsorted(o, start, "right") - 1
    size = end - start
    sentence = _sentences(data, off)[kept[start]]
    if len(start) > 1:  # "i d i o t": join neighbours of one letter each within a text
        single = size == 1
        glue = np.zeros(len(start), bool)
        glue[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
        if glue.any():
            keep_sign = s != 255
            idx = np.flatnonzero(glue)
            for a, b in zip(end[idx - 1], start[idx], strict=True):
                keep_sign[a:b] = False
                s[a:b] = 254
            live = s != 254
            shift = np.cumsum(live) - live
            s = s[live]
            start, text, sentence = shift[start[~glue]], text[~glue], sentence[~glue]
            last = np.append(np.flatnonzero(~glue)[1:], len(end)) - 1
            end = shift[end[last] - 1] + 1
            size = end - start
    h = K.hash_ranges(s, start, end)
    key, first, back = np.unique(h, return_index=True, return_inverse=True)
    st, sz = start[first], size[first]
    out_at = np.cumsum(sz + 2) - (sz + 2)
    signs = np.full(int((sz + 2).sum()), END, np.uint8)
    signs[out_at] = START
    total = int(sz.sum())
    flat = np.arange(total) - np.repeat(np.cumsum(sz) - sz, sz)
    signs[np.repeat(out_at + 1, sz) + flat] = s[np.repeat(st, sz) + flat]
    return Words(signs, out_at, sz + 2, back.reshape(-1), text, key, sentence)


def _sentences(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of the sentence that each byte is in."""
    new = np.zeros(len(data) + 1, np.int32)
    new[1:] = data == K.LINE_END
    new[1:-1] |= STOP[data[:-1]] & (SIGN[data[1:]] == 255)
    new[off] = 1
    return np.cumsum(new[:-1], dtype=np.int32)


def terms(w: Words):
    """(keys, words they start at, gap) of the words of a chunk, with gap 0, and of its gapped pairs within a sentence."""
    h = w.key[w.which]
    yield h, np.arange(len(h)), 0
    for gap in range(1, APART + 1):
        at = np.flatnonzero(w.sentence[gap:] == w.sentence[:-gap])
        yield K.mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + gap]), at, gap


def _fade(gap: int) -> float:
    return DECAY ** max(gap - 1, 0)


def _left(w: Words) -> np.ndarray:
    """Places from each position to the end of its word."""
    ends = np.repeat(w.starts + w.sizes, w.sizes)
    return ends - np.arange(len(w.signs))


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each distinct word, of length one."""
    left, u = _left(w), w.signs
    of = np.repeat(np.arange(len(w.sizes)), w.sizes)
    keys, vals = [], []
    for a, b in _GAPS:
        at = np.flatnonzero(left > a + b)
        keys.append(of[at] * DIM + _bucket(u[at], u[at + a], u[at + a + b]))
        vals.append(np.full(len(at), DECAY ** (a + b + 1)))
    keys, vals = np.concatenate(keys), np.concatenate(vals)
    uniq, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back.reshape(-1), weights=vals, minlength=len(uniq))
    word = uniq // DIM
    norm = np.sqrt(np.bincount(word, weights=total**2, minlength=len(w.sizes)))
    cut = np.searchsorted(word, np.arange(len(w.sizes) + 1))
    return [(uniq[cut[i] : cut[i + 1]] % DIM, total[cut[i] : cut[i + 1]] / max(norm[i], 1e-12)) for i in range(len(w.sizes))]


@dataclass
class ToxicityModel:
    #: The machine folded into one weight per subsequence, its bias, and the least score of a toxic word.
    table: np.ndarray
    bias: float
    threshold: float
    #: A text with so many different words of at least this score is toxic too.
    low: float = np.inf
    least: int = 2
    #: Evidence of each level of words' scores; sorted keys of terms and their weights; mean and variance of a clean word's evidence.
    levels: np.ndarray | None = None
    keys: np.ndarray | None = None
    weights: np.ndarray | None = None
    usual: tuple[float, float] = (0.0, 1.0)
    #: A text is toxic too if a sentence, or all of it, holds so many deviations more evidence than clean text.
    in_sentence: float = np.inf
    in_text: float = np.inf

    def evidence(self, w: Words, score: np.ndarray) -> np.ndarray:
        """Evidence of each word of a chunk, from its score and the terms that start at it."""
        if self.levels is None or not len(w.which):
            return np.zeros(len(w.which))
        out = self.levels[np.searchsorted(LEVELS, score, "right")][w.which]
        if len(self.keys):
            word = out
            for key, at, gap in terms(w):
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[i] == key)
                at, v = at[hit], self.weights[i[hit]] * _fade(gap)
                if not gap:
                    out[at] = np.maximum(out[at], v)
                    word = out.copy()
                else:  # only what a pair says beyond its words
                    out[at] += np.maximum(v - word[at] - word[at + gap], 0)
        return out

    def excess(self, evidence: np.ndarray, per: np.ndarray) -> np.ndarray:
        """How far the evidence of each run of so many words lies above clean text's, in deviations."""
        mean, var = self.usual
        total = K.segment_reduce(np.add, evidence, per, 0.0)
        return (total - mean * per) / np.sqrt(var * per + LEAST_VAR)

    def excesses(self, e: np.ndarray, text: np.ndarray, sentence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(most of a sentence, all of the text) for each of n texts, from the evidence of their words."""
        per = np.bincount(text, minlength=n)
        head = np.flatnonzero(np.diff(sentence, prepend=-1))
        one = self.excess(e, np.diff(np.append(head, len(e))))
        of = np.bincount(text[head], minlength=n)
        return K.segment_reduce(np.maximum, one, of, 0.0), self.excess(e, per)

    def word_scores(self, w: Words) -> np.ndarray:
        """Score of each distinct word; below the thresholds only an upper bound."""
        left, u = _left(w), w.signs
        raw, square, plain = (np.zeros(len(u), np.float32) for _ in range(3))
        for a, b in _GAPS:
            if len(u) <= a + b:
                continue
            at = slice(0, len(u) - a - b)
            ok = left[at] > a + b
            v = DECAY ** (a + b + 1)
            raw[at] += np.where(ok, self.table[_bucket(u[at], u[a : len(u) - b], u[a + b :])], 0) * np.float32(v)
            square[at] += ok * np.float32(v * v)
            plain[at] += ok * np.float32(v)
        if not len(w.sizes):
            return np.zeros(0)
        raw, square, plain = np.add.reduceat(raw, w.starts).astype(np.float64), np.add.reduceat(square, w.starts), np.add.reduceat(plain, w.starts)
        # a word's vector is shortest if no two of its subsequences are the same, longest if all are: this bounds its score from above
        score = raw / np.maximum(np.where(raw > 0, np.sqrt(square), plain), 1e-6) + self.bias
        close = np.flatnonzero(score >= min(self.threshold, self.low, LEVELS[0]))
        for lo in range(0, len(close), 20_000):
            ids = close[lo : lo + 20_000]
            score[ids] = [float(self.table[i] @ v) for i, v in features(w.only(ids))]
            score[ids] += self.bias
        return score

    def hits(self, w: Words, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(toxic words, different weaker words) of each of n texts, from the scores of their words."""
        weak = np.unique(w.text[s >= self.low].astype(np.int64) << 32 | w.which[s >= self.low])
        return np.bincount(w.text[s >= self.threshold], minlength=n), np.bincount(weak >> 32, minlength=n)

    def score(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(highest word score, toxic words, whether it is toxic) of each text; -1 for a text without words."""
        data, off = K.text_buffers(texts)
        n = len(off) - 1
        best, count, some, much = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for lo, hi in K.chunks(off, 2 * K.CHUNK):
            w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            each = self.word_scores(w)
            s = each[w.which] if len(w.which) else np.zeros(0)
            per = np.bincount(w.text, minlength=hi - lo)
            best[lo:hi] = K.segment_reduce(np.maximum, s, per, -1.0)
            count[lo:hi], some[lo:hi] = self.hits(w, s, hi - lo)
            one, whole = self.excesses(self.evidence(w, each), w.text, w.sentence, hi - lo)
            much[lo:hi] = (one >= self.in_sentence) | (whole >= self.in_text)
        return best, count, (count > 0) | (some >= self.least) | much


def _dense(rows, cols: np.ndarray) -> np.ndarray:
    """Inner products of sparse rows with the landmarks, which are columns."""
    return np.array([v.astype(np.float32) @ cols[i] for i, v in rows])


def train(rows: list[tuple[int, str]], landmarks: int = 384, negatives: int = 5000, rounds: int = 4) -> ToxicityModel | None:
    """A model of (toxic, text) rows; None unless both labels occur.

    All words of the rows are counted and scored each round, and all rows decide the thresholds.  The
    machine itself is fitted on the toxic words and on a bounded sample of the clean ones: about
    ``negatives``, a quarter of them the commonest, the rest drawn at random, and after each round
    half as many again, those that the machine takes for toxic most.
    """
    rows = [(t, x) for t, x in rows if x]
    y = np.array([t for t, _ in rows], bool)
    if not y.any() or y.all():
        return None
    known: dict[bytes, int] = {}
    pairs = []
    data, off = K.text_buffers(pa.array([x for _, x in rows], pa.large_string()))
    for lo, hi in K.chunks(off):
        part = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        ids = np.array([known.setdefault(part.name(i), len(known)) for i in range(len(part.sizes))], np.int64)
        if len(ids):
            pairs.append(np.unique((part.text + lo) << 32 | ids[part.which]))
    if not pairs:
        return None
    w, pair = _of_names(list(known)), np.concatenate(pairs)
    n, word, doc = len(known), pair & 0xFFFFFFFF, pair >> 32
    bad = y[doc]
    a, b = np.bincount(word[bad], minlength=n), np.bincount(word[~bad], minlength=n)
    odds = np.log((a + 0.5) / (y.sum() + 1)) - np.log((b + 0.5) / ((~y).sum() + 1))
    sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    strong = np.flatnonzero((odds > 2.5) & (sure > 3.0))
    if not len(strong):
        strong = np.argsort(-odds, kind="stable")[:20]
    clean = np.setdiff1d(np.flatnonzero(b > 0), strong)
    rng = np.random.default_rng(5)
    some = rng.choice(clean, min(len(clean), negatives), replace=False)
    often = clean[np.argsort(-b[clean], kind="stable")][: negatives // 4]
    some = np.union1d(some, often)
    marks = np.concatenate([strong[np.argsort(-sure[strong], kind="stable")][: landmarks // 2], rng.permutation(some)[: landmarks // 2]])
    land = features(w.only(marks))
    dense = np.zeros((DIM, len(land)), np.float32)
    for j, (i, v) in enumerate(land):
        dense[i, j] = v
    kmm = _dense(land, dense)
    ev, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(ev, 1e-4))) @ vec.T
    pos, best = strong, None
    for _ in range(rounds):
        ids = np.concatenate([pos, some])
        z = np.hstack([_dense(features(w.only(ids)), dense) @ root, np.ones((len(ids), 1))])
        y_of = np.where(np.arange(len(ids)) < len(pos), 1.0, -1.0)
        beta = fit_dense_svm(z, y_of, np.where(y_of > 0, a[ids], 1 + np.log1p(b[ids])), cost=30.0)
        best = ToxicityModel((dense @ (root @ beta[:-1]).astype(np.float32)).astype(np.float32), float(beta[-1]), -0.5)
        score = best.word_scores(w)
        top = np.full(len(rows), -1.0)
        np.maximum.at(top, doc, score[word])
        # the next round: each toxic document's best word as its witness, and the clean words that score highest
        order = np.lexsort((-score[word], doc))
        first = np.unique(doc[order], return_index=True)[1]
        at = order[first]
        best.threshold = _cut(top[y], top[~y])
        _calibrate(best, y, top, doc[order], score[word][order])
        witness = word[at][y[doc[at]] & (score[word[at]] > 0) & (odds[word[at]] > 1.5)]
        pos = np.union1d(strong, witness)
        hard = clean[np.argsort(-score[clean], kind="stable")][: negatives // 2]
        some = np.setdiff1d(np.union1d(some, hard[odds[hard] <= 1.5]), pos)
    _weigh(best, y, data, off)
    return best


def _rates(data: np.ndarray, off: np.ndarray, docs: np.ndarray, known: np.ndarray | None = None):
    """(keys, documents, sum of rates, sum of their squares) of the terms of these documents; of the known keys only, if given."""
    got = []
    for d in docs:
        w = words(data[off[d] : off[d + 1]], np.array([0, off[d + 1] - off[d]]))
        if not len(w.which):
            continue
        key, rate = [], []
        for k, _, gap in terms(w):
            if known is not None and len(known):
                k = k[known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k]
            key.append(k)
            rate.append(np.full(len(k), _fade(gap) / len(w.which)))
        key, back = np.unique(np.concatenate(key), return_inverse=True)
        got.append((key, np.bincount(back.reshape(-1), weights=np.concatenate(rate), minlength=len(key))))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    rate = np.concatenate([r for _, r in got])
    key, back = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    back = back.reshape(-1)
    return key, np.bincount(back, minlength=len(key)), np.bincount(back, rate, len(key)), np.bincount(back, rate**2, len(key))


def _weigh(model: ToxicityModel, y: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Chooses the terms that are surely more frequent in toxic documents, and the excess that makes a text toxic."""
    nt, nc = int(y.sum()), int((~y).sum())
    key, docs, one, two = _rates(data, off, np.flatnonzero(y))
    many = docs >= max(3, nt // 50)
    key, one, two = key[many], one[many], two[many]
    clean_one, clean_two = np.zeros(len(key)), np.zeros(len(key))
    if len(key):
        k, _, a, b = _rates(data, off, np.flatnonzero(~y), key)
        at = np.searchsorted(key, k)
        clean_one[at], clean_two[at] = a, b
    weight = _surely(one, two, nt, clean_one, clean_two, nc)
    model.keys, model.weights = key[weight > 0], weight[weight > 0]
    sums = np.zeros((2, 2, len(LEVELS) + 1))
    parts, found = [], np.zeros(len(y), bool)
    for lo, hi in K.chunks(off):
        w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        score = model.word_scores(w)
        level = np.searchsorted(LEVELS, score, "right")[w.which]
        per = np.bincount(w.text, minlength=hi - lo)
        rate = np.bincount(w.text * (len(LEVELS) + 1) + level, minlength=(hi - lo) * (len(LEVELS) + 1)).reshape(hi - lo, -1) / np.maximum(per, 1)[:, None]
        for t in (0, 1):
            mine = rate[y[lo:hi] == t]
            sums[t] += mine.sum(0), (mine**2).sum(0)
        count, some = model.hits(w, score[w.which], hi - lo)
        found[lo:hi] = (count > 0) | (some >= model.least)
        parts.append((lo, hi, w, score))
    model.levels = _surely(*sums[1], nt, *sums[0], nc)
    model.levels[0] = 0
    parts = [(lo, hi, model.evidence(w, score), w.text, w.sentence) for lo, hi, w, score in parts]
    clean = np.concatenate([e[~y[lo:hi][text]] for lo, hi, e, text, _ in parts])
    if len(clean):
        model.usual = (float(clean.mean()), max(float(clean.var()), 1e-6))
    one, whole = np.zeros(len(y)), np.zeros(len(y))
    for lo, hi, e, text, sentence in parts:
        one[lo:hi], whole[lo:hi] = model.excesses(e, text, sentence, hi - lo)
    model.in_text = _least(whole, y, found)
    model.in_sentence = _least(one, y, found | (whole >= model.in_text))


def _surely(one, two, n, clean_one, clean_two, clean_n) -> np.ndarray:
    """Logarithm of how much higher a rate is in toxic documents, from sums and sums of squares; 0 unless surely higher."""
    mt, mc = one / n, clean_one / clean_n
    spread = np.sqrt(np.maximum(two / n - mt**2, 0) / n + np.maximum(clean_two / clean_n - mc**2, 0) / clean_n)
    ratio = np.log(np.maximum(mt, 1e-12) / np.maximum(mc + 0.05 * mt, 1e-12))
    return np.where((ratio > 1.0) & (mt - mc > 4 * np.maximum(spread, 1e-12)), ratio, 0.0)


def _least(excess: np.ndarray, y: np.ndarray, found: np.ndarray, wrong_at_most: float = 0.002) -> float:
    """The excess, one deviation at least, that best separates the documents not found yet and flags at most this share of the clean ones."""
    clean, toxic = np.sort(excess[~y & ~found]), np.sort(excess[y & ~found])
    at = np.unique(np.append(excess[excess > 1], 1.0))
    mids = np.append(1.0, (at[1:] + at[:-1]) / 2)
    caught = (len(toxic) - np.searchsorted(toxic, mids)) / y.sum()
    wrong = (len(clean) - np.searchsorted(clean, mids)) / (~y).sum()
    gain = np.where(wrong <= wrong_at_most, caught - 4 * wrong, -1)
    return float(mids[int(np.argmax(gain))]) if gain.max() > 0 else np.inf


def _cut(toxic: np.ndarray, clean: np.ndarray, wrong_at_most: float = 0.002) -> float:
    """The score that separates best, among those that flag at most this share of the clean documents."""
    at = np.unique(np.concatenate([toxic, clean, [0.0]]))
    # the last one flags nothing, for when no score separates
    mids = np.concatenate([[0.0], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    mids = mids[mids >= -0.5]
    t, c = np.sort(toxic), np.sort(clean)
    caught = 1 - np.searchsorted(t, mids) / len(t)
    wrong = 1 - np.searchsorted(c, mids) / len(c)
    gain = np.where(wrong <= wrong_at_most, caught - 4 * wrong, -1)
    return float(mids[int(np.argmax(gain))])


def _calibrate(model: ToxicityModel, y: np.ndarray, top: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
    """Chooses how many weaker words make a document toxic, and their score; documents' words come in falling order."""
    heads = np.searchsorted(doc, np.arange(len(y)))
    sizes = np.diff(np.append(heads, len(doc)))
    sure = top >= model.threshold
    best = (sure[y].mean() - 4 * sure[~y].mean(), np.inf, 2)
    for least in (2, 3, 4):
        nth = np.full(len(y), -1.0)
        has = sizes >= least
        nth[has] = score[heads[has] + least - 1]
        for low in np.unique(np.quantile(nth[y], np.linspace(0, 1, 101))):
            if -0.4 <= low < model.threshold:
                hit = sure | (nth >= low)
                wrong = hit[~y].mean()
                gain = hit[y].mean() - 4 * wrong
                if wrong <= 0.006 and gain > best[0]:
                    best = (gain, float(low), least)
    _, model.low, model.least = best


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("toxic_words", T.LongType()), T.StructField("toxic", T.BooleanType())])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000, negatives: int = 5000) -> ToxicityModel | None:
    """Fitted on at most ``per_label`` documents of each label, and on about ``negatives`` of their clean words (the documented bounds).

    Documents with several labels are toxic if one says so; null labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("l")).where(F.col("l").isin(0, 1)).groupBy("k").agg(F.max("l").alias("l"))
    ids = bounded_sample(known, "l", "k", per_label)
    got = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).join(F.broadcast(ids), "k").select("l", "t").distinct().toArrow()
    return train(sorted((a, b) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if b), negatives=negatives)


def flag(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score, toxic_words, toxic) for every row of docs: toxic if any word scores at least the
    threshold, several different words score at least a lower one, or the evidence of words and pairs
    of words in a sentence or in the whole text exceeds a clean text's; all bounds come from training.

    ``score`` is the highest score of a word: exact from the lowest bound of the model on (-0.4 or
    less), below it a bound from above that no decision uses.  Signs of a word that are more than
    ``SPAN`` places apart aren't one subsequence, so an insult with more than three signs between each
    two of its own isn't recognised.  Texts at a threshold are toxic.

    A text without words (null, empty, only signs) has score -1 and isn't toxic.  Long texts are
    read whole.  Rows are judged one by one: repeated rows give equal rows, a null doc_id stays
    null, other columns are ignored.  Without both labels there is no model: score is null and
    nothing is toxic.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if held.value is None:
                score, count, bad = pa.nulls(len(b), pa.float64()), np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            else:
                score, count, bad = held.value.score(b.column(1))
                score = pa.array(score)
            yield pa.RecordBatch.from_arrays([b.column(0), score, pa.array(count), pa.array(bad)], names=RESULT.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), RESULT)
