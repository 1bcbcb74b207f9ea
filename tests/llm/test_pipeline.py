"""The pipeline's result against its rules applied in plain Python, and what must stay or go."""

import unicodedata

import corpus_pipeline
import numpy as np
from test_lines_and_copies import lines_left, pairs_of
from test_models import plainly
from test_texts import simple

from marlstone.llm import decontaminate as D
from marlstone.llm import langid, spm


def within(pattern, text, k):
    """Whether the pattern is within k edits of a part of the text, by the plain recurrence a column at a time."""
    p, t = np.frombuffer(pattern.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8)
    row, at = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return row.min() <= k


def windows(text, window=100, step=20, rate=0.06):
    s = simple(text)
    last = max(0, len(s) - window)
    for a in sorted({*range(0, last, step), last}) if len(s) >= D.Q else []:
        p = s[a : a + window]
        yield p, min(int(rate * len(p)), max((len(p) - D.Q) // D.Q, 0))


def test_run_equals_the_plain_rules(spark, sf, docs_of, tmp_path):
    import sentencepiece

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    base = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(50).collect()]
    rows = list(base)
    for i, (_, t, lang) in enumerate(base[:8]):
        w = t.replace("\n", " ").split()
        rows.append((5000 + i, " ".join(w[::-1]) + "\n" + t.split("\n")[0], lang))
        rows.append((6000 + i, " ".join([*w[::-1][: len(w) // 2], "odd", *w[::-1][len(w) // 2 :]]), lang))
        rows.append((7000 + i, " ".join(w[::2]) + " " + items[i % 4][1] + " ﬁn", lang))
        rows.append((8000 + i, "12 34 !!", lang))
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.fit(docs_of(rows))
    left = []
    for d, t, _ in rows:
        _, cover, n = plainly(model, t)
        if n and cover >= 0.5:
            left.append((d, t))
    after = lines_left(left, 0.8)
    left = [(d, after[d]) for d, t in left if after[d] == t or after[d].split()]
    group = {d: d for d, _ in left}
    pairs = pairs_of(left, 0.6)
    for _ in group:
        for a, b, _ in pairs:
            group[a] = group[b] = min(group[a], group[b])
    left = [(d, t) for d, t in left if group[d] == d]
    parts = [w for _, t in items for w in windows(t)]
    left = [(d, t) for d, t in left if not any(within(p, simple(t), k) for p, k in parts)]
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    want = {(d, tuple(sp.encode(unicodedata.normalize("NFKC", t)))) for d, t in left}
    got = {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 0 < len(want) < len(rows) - 12


def test_stages_keep_columns_and_clean_documents(spark, sf, odd, clash, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    # nulls, empty and very long texts, rows that share an id or are repeated, further columns of clashing names, no row at all
    for name, rows in (("odd", clash.unionAll(clash.where("doc_id = 8"))), ("none", odd.limit(0))):
        docs = rows.cache()
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if stage_name != "sentencepiece":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
        ids = [r["doc_id"] for r in docs.collect()]
        assert (ids.count(10) == 2 and not {0, 1, 2, 3, 11} & set(ids)) if name == "odd" else not ids


def test_clean_documents_stay_and_planted_ones_go(spark, sf, tmp_path):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    src = base.where("n_chars > 1500 and lang = 'en'").orderBy("doc_id").first()["text"]
    words = [w for w in src.split() if w.isalpha()]
    clean = " ".join(words[::-1][:120])
    near = clean.split()
    near[60] = "changed"
    extra = [(900001, clean), (900002, " ".join(near)), (900003, clean[: len(clean) // 2][::-1] + " " + item)]
    rows = spark.createDataFrame([(a, t, "en", "s", len(t)) for a, t in extra], base.schema)
    base.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 900001 in left and not {900002, 900003} & left
