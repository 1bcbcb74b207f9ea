"""Language ID by hierarchical discrimination.

A first machine tells language families apart; within a family one-versus-one linear support
vector machines separate the related languages and vote.  Features are the shares of hashed byte
trigrams over the whole text.  Inference is one pass over the text without a shuffle: a gather of
one weight per trigram and machine, summed per text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import bounded_batches, bounded_sample, lean
from .svm import fit_linear_svm

#: Family of each language code; a code that isn't here is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "gu", "pa", "ne"), "indic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
    **dict.fromkeys(("ar", "he", "mt"), "semitic"),
    **dict.fromkeys(("zh", "yue"), "sinitic"),
}

BITS = 16
DIM = 1 << BITS
#: Features are shares times this, so that a text's vector has a length of about one.
SCALE = 30.0
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each position, whether it counts): a trigram within a text that has a letter."""
    b = _CLASS[K.lower(data)]
    n = len(b)
    if n < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    u = b.astype(np.uint32)
    tri = u[:-2] | (u[1:-1] << np.uint32(8)) | (u[2:] << np.uint32(16))
    ok = tri != 0x202020
    for back in (1, 2):
        at = off[1:-1] - back
        ok[at[(at >= 0) & (at < n - 2)]] = False
    return (tri * np.uint32(2654435761)) >> np.uint32(32 - BITS), ok


def _padded(texts) -> pa.Array:
    """Each text between two spaces, so that a text of one letter has a trigram."""
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, K.column(texts), space, pa.scalar("", pa.large_string()))


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum over each text's positions (the last two positions of the data have no trigram)."""
    total = np.zeros(int(off[-1]) + 1, np.float64)
    np.cumsum(values, out=total[1 : len(values) + 1], dtype=np.float64)
    total[len(values) + 1 :] = total[len(values)]
    return total[off[1:]] - total[off[:-1]]


@dataclass
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]
    #: (group, first, second) of each machine: group "" separates families.
    duels: list[tuple[str, str, str]]
    weights: np.ndarray
    seen: np.ndarray
    accuracy: float = field(default=1.0)

    def predict(self, texts) -> dict[str, list]:
        data, off = K.text_buffers(_padded(texts))
        n = len(off) - 1
        scores, count, cover = np.zeros((len(self.duels), n)), np.zeros(n), np.zeros(n)
        for lo, hi in K.chunks(off):
            o = off[lo : hi + 1] - off[lo]
            idx, ok = _trigrams(data[off[lo] : off[hi]], o)
            idx = np.where(ok, idx, np.uint32(DIM))  # a bucket of weight 0
            count[lo:hi] = _per_text(ok, o)
            cover[lo:hi] = _per_text(self.seen[idx], o)
            for d in range(len(self.duels)):
                scores[d, lo:hi] = _per_text(self.weights[d][idx], o)
        scores *= SCALE / np.maximum(count, 1)
        cover /= np.maximum(count, 1)
        fam, fam_margin = self._vote("", self.families, scores, n)
        lang, margin = np.zeros(n, object), np.zeros(n)
        for k, f in enumerate(self.families):
            at = fam == k
            best, m = self._vote(f, self.languages[f], scores[:, at], int(at.sum()))
            lang[at] = np.array(self.languages[f], object)[best]
            margin[at] = np.minimum(m, fam_margin[at]) if len(self.languages[f]) > 1 else fam_margin[at]
        return {"family": list(np.array(self.families, object)[fam]), "lang_pred": list(lang), "margin": margin, "coverage": cover, "n_grams": count.astype(np.int64)}

    def _vote(self, group: str, names: list[str], scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, ties by summed margins then by name; and its least margin over the others."""
        votes, total, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for d, (g, a, b) in enumerate(self.duels):
            if g == group:
                i, j = names.index(a), names.index(b)
                s = scores[d]
                votes[i] += s >= 0
                votes[j] += s < 0
                total[i] += s
                total[j] -= s
                least[i] = np.minimum(least[i], s)
                least[j] = np.minimum(least[j], -s)
        best = np.argmax(votes + np.tanh(total) * 0.4, axis=0) if len(names) > 1 else np.zeros(n, np.int64)
        m = least[best, np.arange(n)]
        return best, np.where(np.isfinite(m), m, 1.0)


def train(rows: list[tuple[str, str]]) -> LanguageModel | None:
    """A model of (language, text) rows: each whole text and each of its lines is an example."""
    rows = [(lang, text) for lang, text in rows if lang and text]
    if not rows:
        return None
    texts, langs = [], []
    for lang, text in rows:
        for x in {text, *text.split("\n")}:
            texts.append(x)
            langs.append(lang)
    data, off = K.text_buffers(_padded(pa.array(texts, pa.large_string())))
    idx, ok = _trigrams(data, off)
    examples, labels, seen = [], [], np.zeros(DIM + 1, np.float32)
    for i, lang in enumerate(langs):
        part = idx[off[i] : off[i + 1]][ok[off[i] : off[i + 1]]]
        if len(part) >= 5:
            u, c = np.unique(part, return_counts=True)
            examples.append((u, c * (SCALE / len(part))))
            labels.append(lang)
            seen[u] = 1
    if not examples:
        return None
    labels = np.array(labels)
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        by_family.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    families = sorted(by_family)
    family = np.array([FAMILIES.get(x, x) for x in labels])
    duels, weights = [], []
    for group, names, of in [("", families, family), *((f, by_family[f], labels) for f in families)]:
        for a, b in combinations(names, 2):
            at = np.flatnonzero((of == a) | (of == b))
            w = fit_linear_svm([examples[i] for i in at], np.where(of[at] == a, 1, -1), DIM)
            duels.append((group, a, b))
            weights.append(np.append(w, 0).astype(np.float32))
    return LanguageModel(families, by_family, duels, np.array(weights).reshape(len(duels), DIM + 1), seen)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("family", T.StringType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("margin", T.DoubleType()), T.StructField("coverage", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def fit(docs: DataFrame, per_language: int = 400) -> LanguageModel | None:
    """Fitted on at most ``per_language`` labelled documents of each language (the documented bound)."""
    ids = bounded_sample(docs.select(F.col("doc_id").alias("k"), F.col("lang").alias("l")), "l", "k", per_language).select("k")
    rows = docs.select(F.col("doc_id").alias("k"), F.col("lang").alias("l"), F.col("text").alias("t")).join(F.broadcast(ids.distinct()), "k").select("l", "t")
    got = rows.toArrow()
    return train(sorted((a, b) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if a and b))


def judge(model: LanguageModel | None, texts, min_coverage: float) -> dict:
    """Columns of the decision for an Arrow column of texts."""
    n = len(texts)
    if model is None:
        return {"family": [None] * n, "lang_pred": [None] * n, "margin": np.zeros(n), "coverage": np.zeros(n), "kept": np.ones(n, bool)}
    got = model.predict(texts)
    kept = (got["n_grams"] > 0) & (got["coverage"] >= min_coverage)
    got["family"] = [f if k else UNKNOWN for f, k in zip(got["family"], kept, strict=True)]
    got["lang_pred"] = [x if k else UNKNOWN for x, k in zip(got["lang_pred"], kept, strict=True)]
    return got | {"kept": kept}


def identify(docs: DataFrame, model: LanguageModel | None, min_coverage: float = 0.5) -> DataFrame:
    """(doc_id, family, lang_pred, margin, coverage, kept) for every row of docs.

    A text that has no letter (null, empty, only digits or signs), or
    less than ``min_coverage`` of whose trigrams occurred in training, is ``und`` and not kept.
    Whole texts are read, whatever their length.  Languages with equally many votes are told by their
    summed margins, then by name.  Rows are judged one by one: repeated rows get
    equal results, a null doc_id stays null, other columns are ignored.  Without any labelled row
    there is no model: language and family are null and everything is kept.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = judge(held.value, b.column(1), min_coverage)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got["family"], pa.string()), pa.array(got["lang_pred"], pa.string()), pa.array(got["margin"], pa.float64()), pa.array(got["coverage"], pa.float64()), pa.array(got["kept"], pa.bool_())], names=RESULT.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), RESULT)


def keep_identified(docs: DataFrame, per_language: int = 400, min_coverage: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in a language that the model knows; all columns as they are.

    Null and empty texts, and texts without letters, go; repeated rows stay or go together, and
    without any labelled row everything stays; see ``identify``.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, per_language)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(held.value, b.column(at), min_coverage)["kept"], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
