"""Line dedup and the n-gram Jaccard join against brute force."""

import itertools
import random

import pyarrow as pa
from compare import same_rows

from marlstone.llm import linededup, neardup


def lines_left(docs, t):
    """The rules of line dedup, pair by pair."""
    seen, out = [], {}
    sets = [(d, i, frozenset(line.lower().split()), line) for d, text in sorted(docs) for i, line in enumerate(text.split("\n"))]
    for d, i, s, line in sets:
        hit = s and any(len(s & o) >= t * len(s | o) - 1e-9 for e, j, o in seen)
        if s:
            seen.append((d, i, s))
        out.setdefault(d, []).append(None if hit else line)
    return {d: "\n".join(x for x in v if x is not None) for d, v in out.items()}


def noisy(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.randrange(1, 25))] for _ in range(25)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randrange(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            r.shuffle(w)
            lines.append(" ".join(w).capitalize())
        rows.append((d, "\n".join(lines)))
    return rows


def test_lines_equal_brute_force(docs_of):
    for seed, t in ((1, 0.8), (2, 0.6)):
        rows = noisy(seed)
        got = {r["doc_id"]: r["text"] for r in linededup.clean(docs_of(rows), t, bits=18, drop_emptied=False).collect()}
        assert got == lines_left(rows, t)


def test_a_saturated_sketch_changes_nothing(docs_of):
    # some 60 words in 4 buckets
    rows = noisy(3)
    got = {r["doc_id"]: r["text"] for r in linededup.clean(docs_of(rows), 0.8, bits=2, drop_emptied=False).collect()}
    assert got == lines_left(rows, 0.8)


def test_lines_and_sizes_of_any_number_are_told_apart(docs_of):
    n = (1 << 23) + 5
    text = "\n" * n + "alpha beta gamma delta epsilon"
    rows = [(1, text), (2, "alpha beta gamma delta epsilon\nzeta eta theta")]
    got = {r["doc_id"]: (r["removed"], r["text"]) for r in linededup.report(docs_of(rows), 0.7).collect()}
    assert got[1] == (0, text) and got[2] == (1, "zeta eta theta")
    near = [(1, "\n" * n + "alpha beta gamma delta epsilon\nalpha beta gamma delta zeta"), (2, "one two")]
    got = {r["doc_id"]: r["removed"] for r in linededup.report(docs_of(near), 0.6).collect()}
    assert got == {1: 1, 2: 0}


def test_lines_agree_with_sql(spark, sf, duck):
    from marlstone.llm.queries import ORACLES, QUERIES

    same_rows(QUERIES["op1_line_dedup"](spark, sf), duck, ORACLES["op1_line_dedup"])


def test_lines_in_edge_cases(odd, clash, empty):
    out = linededup.clean(odd)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == odd.columns
    texts = {d: t for d, t in got}
    assert texts[0] is None and texts[1] == "" and texts[3] == "\n\n"
    # the second of two equal texts goes, as does a row that repeats it; a row of the same id stays
    assert 11 not in texts and [d for d, _ in got].count(10) == 2
    assert None in texts and len(texts[8]) == 300_000 and len(texts[9]) == 199_999
    assert linededup.clean(clash).columns == clash.columns and linededup.clean(clash).count() == len(got)
    assert linededup.clean(empty).count() == 0


def test_repeats_within_a_text(docs_of):
    got = linededup.report(docs_of([(1, "One two\nother\none  TWO"), (2, "other\nnew words here")])).collect()
    assert {r["doc_id"]: (r["removed"], r["text"]) for r in got} == {1: (1, "One two\nother"), 2: (1, "new words here")}


def grams(text, n=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(rows, t):
    sets = {d: grams(x) for d, x in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def pairs_of(rows, t, ngram=3):
    """The rows that the join must give, by the docstring's rules, pair by pair: the sets' smallest documents."""
    sets = {}
    for d, x in rows:
        if g := frozenset(grams(x, ngram)):
            sets.setdefault(g, set()).add(d)
    rep = {g: min(ds) for g, ds in sets.items()}
    out = {(rep[g], d, 1.0) for g, ds in sets.items() for d in ds if d != rep[g]}
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= t * len(a | b) - 1e-9 and rep[a] != rep[b]:
            out.add((min(rep[a], rep[b]), max(rep[a], rep[b]), round(len(a & b) / len(a | b), 6)))
    return out


def links_of(rows, t, ngram=3):
    """(doc, class, links) by the docstring's rules, text by text."""
    texts = sorted({(d, frozenset(grams(x, ngram))) for d, x in rows if d is not None}, key=lambda x: x[0])
    count, group = {d: 0 for d, _ in texts}, {d: d for d, _ in texts}
    near = [(d, e) for (d, a), (e, b) in itertools.combinations(texts, 2) if a and b and len(a & b) >= t * len(a | b) - 1e-9]
    for d, e in near:
        count[d] += 1
        count[e] += 1
    for _ in range(len(texts)):
        for d, e in near:
            group[d] = group[e] = min(group[d], group[e])
    return sorted((d, group[d], n) for d, n in count.items())


def linked(df):
    return sorted((r["doc_id"], r["class_id"], r["links"]) for r in df.collect())


def found(df):
    return {(r["doc_a"], r["doc_b"], round(r["jaccard"], 6)) for r in df.collect()}


def at_the_threshold(seed, pairs=60):
    """Pairs of texts whose Jaccard is 0.6 or little more: most of what a hash banding misses."""
    r = random.Random(seed)
    rows = []
    for p in range(pairs):
        w = [f"p{p}w{i}" for i in range(82)]
        # 80 n-grams, of which 20 go: 60 of 100 in common; or fewer
        cut = r.choice((20, 20, 19, 18))
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join([*w[: 82 - cut], *(f"q{p}w{i}" for i in range(cut))]))]
    return rows


def test_no_pair_at_the_threshold_is_left_out(docs_of):
    rows = at_the_threshold(4)
    want = pairs_of(rows, 0.6)
    assert len(want) == 60 and found(neardup.join(docs_of(rows))) == want
    # a sketch that tells nothing changes nothing
    assert linked(neardup.links(docs_of(rows), bits=2)) == links_of(rows, 0.6)


def test_a_full_sketch_still_puts_rare_words_first(docs_of):
    # half of each text is of six words: texts meet by chance if its n-grams come first
    r = random.Random(9)
    rows = [(d, " ".join([f"r{r.randrange(20_000)}" for _ in range(70)] + [f"c{r.randrange(6)}" for _ in range(60)])) for d in range(100)]
    c = neardup._Candidates(docs_of(rows), 0.6, 3, 8)
    assert c.tied.count() == 0
    rows += [(100 + d, text + " more") for d, text in rows[:10]]
    assert found(neardup.join(docs_of(rows), bits=8)) == pairs_of(rows, 0.6)


def test_links_equal_brute_force(docs_of, odd, clash, empty, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = clusters(6)
    got = linked(neardup.links(docs_of(rows)))
    assert got == links_of(rows, 0.6) and max(n for _, _, n in got) > 3
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert linked(neardup.links(odd)) == linked(neardup.links(clash)) == links_of(rows, 0.6)
    assert neardup.links(empty).count() == 0 and neardup.links(empty).columns == ["doc_id", "class_id", "links"]


def test_links_are_as_many_rows_as_documents(docs_of):
    base = [f"t{i}" for i in range(60)]
    rows = [(d, " ".join([*base, f"x{d % 30}"])) for d in range(60)]
    assert linked(neardup.links(docs_of(rows))) == [(d, 0, 59) for d in range(60)]


def test_join_recall_and_precision(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    df = neardup.join(documents)
    got = found(df)
    assert got == pairs_of(rows, 0.6) and df.columns == ["doc_a", "doc_b", "jaccard"] and len(got) == df.count()
    # every pair of alike sets, by their smallest documents, but for the share that the banding may miss
    small = {}
    for d, x in sorted(rows):
        small.setdefault(frozenset(grams(x)), d)
    true = {tuple(sorted((small[frozenset(grams(dict(rows)[a]))], small[frozenset(grams(dict(rows)[b]))]))) for a, b in alike(rows, 0.6)}
    true = {(a, b) for a, b in true if a != b}
    assert true and len({(a, b) for a, b, _ in got} & true) >= 0.9 * len(true)


def test_large_groups_are_split_and_still_whole(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(40):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"x{d}"
        rows.append((d, " ".join(w)))
    got = found(neardup.join(docs_of(rows)))
    true = alike(rows, 0.6)
    assert got == pairs_of(rows, 0.6) and len(got) >= 0.9 * len(true)
    assert [r["doc_id"] for r in neardup.deduplicate(docs_of(rows)).collect()] == [0]


def test_join_in_edge_cases(odd, clash, empty):
    rows = neardup.join(odd).collect()
    assert [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in rows] == [(10, 11, 1.0)]
    assert found(neardup.join(clash)) == {(10, 11, 1.0)}
    kept = neardup.deduplicate(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and 11 not in ids and ids.count(10) == 2 and None in ids and len(ids) == odd.count() - 1
    assert neardup.deduplicate(clash).count() == len(ids)
    assert neardup.join(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def clusters(seed, n=120):
    """Chains of ever less alike texts, tight groups, exact copies and texts that share one passage."""
    r = random.Random(seed)
    fresh = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    passage, rows, base = fresh(30), [], fresh(80)
    for d in range(n):
        kind = d % 5
        if kind == 0:
            base = base[8:] + fresh(8)
            w = list(base)
        elif kind == 1:
            w = list(base)
            w[r.randrange(80)] = f"x{d}"
        elif kind == 2:
            w = list(base)
        elif kind == 3:
            w = fresh(25) + passage + fresh(25)
        else:
            w = fresh(r.randrange(1, 6))
        rows.append((r.randrange(10**6), " ".join(w)))
    return [*rows, (rows[0][0], rows[2][1]), (rows[0][0], rows[0][1]), (rows[7][0], "quite another text of the same id")]


def test_join_and_dedup_equal_brute_force(docs_of, monkeypatch):
    for seed, block in ((2, 4),):
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = clusters(seed)
        got, want = found(neardup.join(docs_of(rows))), pairs_of(rows, 0.6)
        assert got == want and len(want) > 50
        group = {d: d for d, _ in rows}
        for _ in range(len(rows)):
            for a, b, _ in want:
                group[a] = group[b] = min(group[a], group[b])
        assert sorted(r["doc_id"] for r in neardup.deduplicate(docs_of(rows)).collect()) == sorted(d for d, _ in rows if group[d] == d)


def test_a_text_of_more_than_a_million_lines_keeps_its_lines_apart():
    import numpy as np
    import pyarrow as pa

    from marlstone.llm import textkernel as K
    from marlstone.llm.linededup import _Sets

    def sets(text):
        data, off = K.text_buffers(pa.array([text]))
        return _Sets(data, off, None, 24)

    many = sets("a b c d\n" + "x\n" * ((1 << 20) - 1) + "e f\na b c d\n")
    few = sets("a b c d\nx\ne f\na b c d\n")
    for one, other in ((0, 0), (1, 1), ((1 << 20), 2), ((1 << 20) + 1, 3)):
        a, b = (x.h[x.at[i] : x.at[i] + x.size[i]] for x, i in ((many, one), (few, other)))
        assert np.array_equal(a, b) and many.k1[one] == few.k1[other]
