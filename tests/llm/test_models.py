"""Language ID and toxicity: held-out accuracy and edge cases."""

import pyarrow as pa

from marlstone.llm import langid, toxicity


def test_languages_held_out(documents):
    rows = [(r["lang"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    train, test = rows[::2], rows[1::2]
    got = langid.judge(langid.train(train), pa.array([t for _, t in test]), 0.5)
    right = sum(a == b for (a, _), b in zip(test, got["lang_pred"], strict=True))
    assert right >= 0.97 * len(test) and sum(got["kept"]) >= 0.99 * len(test)


def test_families_come_first(documents):
    model = langid.train([(r["lang"], r["text"]) for r in documents.collect()])
    assert model.families == ["germanic", "romance"] and model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [d[0] for d in model.duels] == ["", "germanic", "romance"]


def test_language_edge_cases(odd, clash, empty, documents):
    model = langid.fit(documents, 100)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    for i in (0, 1, 2, 3, 5):
        assert got[i]["lang_pred"] == "und" and not got[i]["kept"]
    assert got[10]["lang_pred"] == got[11]["lang_pred"] and None in got
    assert langid.identify(odd, None).where("kept").count() == odd.count()
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty) is None
    kept = langid.keep_identified(clash.unionByName(clash), 50)
    assert kept.columns == clash.columns


def test_strangers_are_rejected(documents, docs_of):
    model = langid.fit(documents, 100)
    got = langid.identify(docs_of([(1, "это совсем другой язык и другие буквы"), (2, "12345 67890 !!!")]), model).collect()
    assert not any(r["kept"] for r in got)


INSULTS = ["idiot", "moron", "scum"]


def sample():
    import random

    r = random.Random(3)
    syll = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "is", "it", "ou", "al", "st"]
    rows = []
    for i in range(400):
        words = ["".join(r.choice(syll) for _ in range(r.randrange(1, 5))) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(r.randrange(40), r.choice(INSULTS))
        rows.append((int(bad), " ".join(words)))
    return rows


def test_insults_are_caught_with_gaps_and_insertions():
    rows = sample()
    model = toxicity.train(rows[:300], landmarks=64, negatives=800)
    best, count, bad = model.score(pa.array([t for _, t in rows[300:]]))
    y = [bool(a) for a, _ in rows[300:]]
    assert sum(a == c for a, c in zip(y, bad, strict=True)) >= 97
    odd = ["an idiiot here", "i d i o t", "m.o.r.o.n", "id1ot", "morron", "perfectly fine in the heat", "", None]
    assert [c > 0 for c in model.score(pa.array(odd))[1]] == [True] * 5 + [False] * 3


def kernel_vector(signs):
    """Weights of a word's subsequences of three signs, by going through all of them."""
    import numpy as np

    v = np.zeros(toxicity.DIM)
    n = len(signs)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, min(n, i + toxicity.SPAN)):
                x, y, z = (np.array([signs[p]], np.uint8) for p in (i, j, k))
                v[int(toxicity._bucket(x, y, z)[0])] += toxicity.DECAY ** (k - i + 1)
    return v / max(np.linalg.norm(v), 1e-12)


def test_scoring_by_the_table_is_the_kernel_expansion():
    import numpy as np

    from marlstone.llm import textkernel as K

    data, off = K.text_buffers(pa.array(["idiot idiots idxiot thing banana a"]))
    w = toxicity.words(data, off)
    names = [bytes(x + 97 for x in w.name(i)[1:-1]).decode() for i in range(len(w.sizes))]
    plain = {n: kernel_vector(list(w.name(i))) for i, n in enumerate(names)}
    for n, (i, v) in zip(names, toxicity.features(w), strict=True):
        assert np.allclose(plain[n][i], v) and np.isclose((plain[n] ** 2).sum(), (v**2).sum())
    # the machine over landmarks, sum of beta k(landmark, word), is one gather a subsequence
    beta = {"idiot": 2.0, "thing": -1.5, "banana": -0.5}
    table = sum(c * plain[n] for n, c in beta.items())
    model = toxicity.ToxicityModel(table.astype(np.float32), 0.25, -9.0)
    want = [sum(c * float(plain[m] @ plain[n]) for m, c in beta.items()) + 0.25 for n in names]
    assert np.allclose(model.word_scores(w), want, atol=1e-5)
    # words below the threshold have a bound from above
    model.threshold = model.low = 1.0
    assert (model.word_scores(w) >= np.array(want) - 1e-5).all()
    score = dict(zip(names, want, strict=True))
    assert score["idxiot"] > 1 > score["banana"] and plain["idiot"] @ plain["idxiot"] > 0.5 > plain["idiot"] @ plain["thing"]


def test_held_out_documents_and_labels(spark, sf):
    import os

    d = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    y = {r["doc_id"]: bool(r["toxic"]) for r in labels.collect()}
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.flag(docs.where("doc_id % 2 = 1"), model).collect()}
    bad = [i for i in got if y.get(i)]
    good = [i for i in got if i in y and not y[i]]
    assert bad and sum(got[i] for i in bad) >= 0.85 * len(bad) and sum(got[i] for i in good) <= 0.02 * len(good)


def plainly(model, text):
    """(language, coverage, trigrams) of a text, trigram by trigram."""
    low = f" {text or ''} ".lower().encode() if (text or "").isascii() else (" " + "".join(c.lower() if len(c.encode()) == 1 or "À" <= c <= "Þ" and c != "×" else c for c in text or "") + " ").encode()
    b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in low]
    idx = [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2) if b[i : i + 3] != [32] * 3]
    if not idx:
        return "und", 0.0, 0
    cover = sum(float(model.seen[i]) for i in idx) / len(idx)
    scores = [sum(float(w[i]) for i in idx) * langid.SCALE / len(idx) for w in model.weights]

    def best(group, names):
        votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (g, x, y), s in zip(model.duels, scores, strict=True):
            if g == group:
                votes[x if s >= 0 else y] += 1
                total[x] += s
                total[y] -= s
        return max(names, key=lambda n: (votes[n], total[n]))

    family = best("", model.families)
    return best(family, model.languages[family]), cover, len(idx)


def test_identification_equals_the_plain_rule(spark, sf, documents):
    from marlstone.llm.queries import QUERIES

    model = langid.fit(documents)
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    for r in documents.where("n_chars < 3000").limit(80).collect():
        lang, cover, n = plainly(model, r["text"])
        kept = n > 0 and cover >= 0.5
        g = got[r["doc_id"]]
        assert g["kept"] == kept and abs(g["coverage"] - cover) < 1e-6 and g["lang_pred"] == (lang if kept else "und")


def test_toxicity_edge_cases(odd, clash, empty, spark):
    model = toxicity.train(sample()[:200], landmarks=32, negatives=300)
    got = toxicity.flag(odd, model).collect()
    assert len(got) == odd.count() and not any(r["toxic"] for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {-1.0}
    assert toxicity.flag(clash, model).count() == odd.count() and toxicity.flag(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels) is None
    assert [r["toxic"] for r in toxicity.flag(odd.limit(1), None).collect()] == [False]


def test_toxicity_of_several_words_and_of_frequent_words():
    import random

    r = random.Random(8)
    base = ["w" + "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(60)]
    one, two, often = base[0], base[1], base[2]

    def text(kind):
        # every text holds one, two and often singly; toxic ones hold "one two" in a sentence, or often many times
        sent = [[r.choice(base[3:]) for _ in range(8)] for _ in range(12)]
        for i, x in enumerate((one, two, often)):
            sent[3 * i].insert(r.randrange(8), x)
        if kind == 1:
            sent[10][4:4] = [one, two]
        if kind == 2:
            for s in sent:
                s.insert(r.randrange(8), often)
        return " ".join(" ".join(s) + "." for s in sent)

    rows = [(int(k > 0), text(k)) for k in [0, 0, 0, 0, 1, 2] * 80]
    model = toxicity.train(rows, landmarks=32, negatives=100)
    held = [(k, text(k)) for k in [0, 0, 1, 2] * 30]
    bad = model.score(pa.array([t for _, t in held]))[2]
    caught = {kind: sum(bool(b) for (k, _), b in zip(held, bad, strict=True) if k == kind) for kind in (0, 1, 2)}
    assert caught[1] >= 28 and caught[2] >= 28 and caught[0] <= 2
