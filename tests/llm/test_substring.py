import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from verdimill.llm import substring
from verdimill.llm.substring import MIN_WORDS, align, compact_windows, cut_words, near_passages, remove_repeats, window_rows


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n)]


def spans(df):
    return [(r.doc_id, r.start_word, r.end_word, r.rep_doc_id, r.rep_start_word, r.rep_end_word) for r in near_passages(df).collect() if r.is_copy]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 8))
def test_windows_hold_every_run_once(values, width):
    """Each subsequence of the width lies in the range of one node: its leftmost minimum."""
    v = np.array(values, np.uint64) << np.uint64(20)
    l, c, r = compact_windows(v, width)
    assert len(set(c.tolist())) == len(c)
    for i in range(len(v) - width + 1):
        holders = [k for k in range(len(c)) if l[k] <= i <= c[k] < i + width <= r[k]]
        assert [int(c[k]) for k in holders] == [i + int(v[i : i + width].argmin())]


def test_repeated_words_stay_cheap(spark):
    df = spark.createDataFrame([(1, "a " * 100_000), (2, "b a " * 50_000)], "doc_id long, text string")
    assert window_rows(df).count() < 10_000


def test_planted_passages(spark):
    rng = random.Random(5)
    p, q = words(rng, 55), words(rng, 120)
    near = list(q)
    near[40], near[80] = "changed", "twice"
    docs = [
        (10, words(rng, 100) + p + words(rng, 30)),
        (11, p + words(rng, 200)),
        (12, words(rng, 80) + q),
        (13, words(rng, 40) + near + words(rng, 10)),
        (14, words(rng, 300)),
        (15, words(rng, 49)),
        (16, p[:40] + words(rng, 60)),
        (17, [w.upper() for w in p]),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = spans(df)
    assert (11, 0, 55, 10, 100, 155) in got and (17, 0, 55, 10, 100, 155) in got
    assert (13, 40, 160, 12, 80, 200) in got
    assert {g[0] for g in got} == {11, 13, 17}
    kept = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert 17 not in kept and len(kept[11].split()) == 200 and kept[14] == " ".join(docs[4][1])
    assert kept[13].split() == docs[3][1][:40] + docs[3][1][160:]


def test_many_sharers_and_copies(spark):
    rng = random.Random(6)
    p, line = words(rng, 70), words(rng, 14)
    docs = [(i, words(rng, 20 + i % 50) + p + line + words(rng, 30)) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)] + [(2000 + i, words(rng, 30) + line + words(rng, 30)) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(9)
    got = near_passages(df).collect()
    copies = {r.doc_id for r in got if r.is_copy}
    assert copies == set(range(1, 300)) | set(range(1000, 1200))
    assert len(got) < 3000  # linear in the texts, not in pairs
    by = {i: w for i, w in docs}
    for r in got:
        assert r.rep_doc_id <= r.doc_id and r.end_word - r.start_word >= MIN_WORDS
        a, b = by[r.doc_id][r.start_word : r.end_word], by[r.rep_doc_id][r.rep_start_word : r.rep_end_word]
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        assert len(x & y) / len(x | y) >= 0.8


def test_edge_cases(spark):
    text = " ".join(words(random.Random(1), 60))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, text, "c"), (3, text, "d"), (3, text, "e"), (4, "x " * 5000, "f")], "doc_id long, text string, pair string")
    assert near_passages(df).collect() == []
    assert sorted(map(str, remove_repeats(df).collect())) == sorted(map(str, df.collect()))
    assert near_passages(df.limit(0)).collect() == [] and remove_repeats(df.limit(0)).collect() == []


def test_align_and_cut():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, 200).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 1 << 32, 30).astype(np.uint32), a[20:90], rng.integers(0, 1 << 32, 5).astype(np.uint32)])
    assert align(a, b) == [(20, 90, 30, 100, 1.0)]
    assert align(a, a[:49]) == [] and align(a[:3], b) == []
    assert cut_words(b" a b\n\nc  d ", [(1, 3)]) == b" a  d "
    assert cut_words("é x".encode(), [(0, 2)]) == b""


def test_documents_hold_what_is_reported(spark, sf):
    docs = {r.doc_id: r.text.encode().lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = near_passages(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    found = {r.doc_id for r in got if r.is_copy}
    grams: dict = {}
    for i in sorted(docs):  # brute force: exact runs of 60 words
        for k in range(len(docs[i]) - 59):
            grams.setdefault(tuple(docs[i][k : k + 60]), set()).add(i)
    want = {max(s) for s in grams.values() if len(s) > 1}
    assert want <= found


def test_near_passages_of_fifty_words_and_more(spark):
    """Two documents each that share only 50 to 60 words with one edit anywhere; none is missed."""
    rng = random.Random(8)
    docs, want = [], set()
    for t in range(400):
        p = words(rng, rng.randrange(50, 61))
        q, at = list(p), rng.randrange(5, len(p) - 5)
        q[at : at + 1] = [["changed"], ["put", q[at]]][t % 2]
        docs += [(2 * t, words(rng, rng.randrange(90)) + p + words(rng, rng.randrange(90))), (2 * t + 1, words(rng, rng.randrange(90)) + q + words(rng, rng.randrange(90)))]
        want.add((2 * t + 1, 2 * t))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(5)
    assert {(g[0], g[3]) for g in spans(df)} == want


def test_a_fragment_hides_no_passage(spark):
    """The first text of a group holds only a part of what the others share; so do several groups of them."""
    rng = random.Random(9)
    line, docs, want = words(rng, 30), [], set()
    for k in range(30):  # 49 of 51 words stand in an earlier text
        p = words(rng, 51)
        docs += [(k, words(rng, 40) + p[1:50] + words(rng, 40))] + [(100 + 10 * k + i, words(rng, 30) + p + words(rng, 30)) for i in range(3)]
        want |= {(100 + 10 * k + i, 30, 81, 100 + 10 * k, 30, 81) for i in (1, 2)}
    q = [line + words(rng, 40) for _ in range(6)]
    docs += [(40, words(rng, 20) + line + words(rng, 50))] + [(1000 + i, words(rng, 30) + q[i % 6] + words(rng, 30)) for i in range(60)]
    want |= {(1000 + i, 30, 100, 1000 + i % 6, 30, 100) for i in range(6, 60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(7)
    got = spans(df)
    assert want <= set(got) and {g[0] for g in got} == {g[0] for g in want}


def test_every_sharer_of_fifty_words_is_found(spark, sf):
    """Brute force: each document but the first of each exact run of 50 words has a copy that holds the run's words."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text.encode().lower().split() for r in documents.collect()}
    grams: dict = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            grams.setdefault(tuple(docs[i][k : k + 50]), []).append((i, k))
    want = {(i, k) for at in grams.values() for i, k in at if i != at[0][0]}
    covered: dict = {}
    for g in spans(documents):
        covered.setdefault(g[0], set()).update(range(g[1], g[2]))
    missed = sorted(w for w in want if not set(range(w[1], w[1] + 50)) <= covered.get(w[0], set()))
    assert want and missed == []


def test_an_earlier_line_hides_no_passage(spark):
    """An earlier text holds only a line; two later ones share a passage around it."""
    rng = random.Random(10)
    docs, want = [], set()
    for t in range(100):
        length, whole = rng.choice([(30, 52), (35, 55), (40, 56), (45, 57), (48, 68)])
        line = words(rng, length)
        before = rng.randrange(whole - length + 1)
        p = words(rng, before) + line + words(rng, whole - length - before)
        docs.append((t, words(rng, 40) + line + words(rng, 40)))
        docs += [(1000 + 2 * t + i, words(rng, 30) + p + words(rng, 30)) for i in (0, 1)]
        want.add((1001 + 2 * t, 30, 30 + whole, 1000 + 2 * t, 30, 30 + whole))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    assert set(spans(df)) == want


def test_very_long_passages(spark):
    rng = random.Random(11)
    p = words(rng, 70_000)
    df = spark.createDataFrame([(1, " ".join(words(rng, 100) + p)), (2, " ".join(p + words(rng, 9)))], "doc_id long, text string")
    assert spans(df) == [(2, 0, 70_000, 1, 100, 70_100)]


def test_groups_beyond_the_limit_are_split(spark, monkeypatch):
    """With tasks of at most 8 members the same links are found."""
    rng = random.Random(12)
    line = words(rng, 28)
    q = [words(rng, 15) + line + words(rng, 15) for _ in range(10)]
    docs = [(0, words(rng, 20) + line + words(rng, 20))] + [(1 + i, words(rng, 20) + q[i % 10] + words(rng, 20)) for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    whole = sorted(spans(df))
    monkeypatch.setattr(substring.regrouped, "__defaults__", (8,))
    assert {g[0] for g in whole} == set(range(11, 61))
    assert {g[:3] for g in spans(df)} == {g[:3] for g in whole}


def test_copies_and_repeated_words(spark):
    """Texts of equal words have one row each; stretches of one word meet if they are passages."""
    rng = random.Random(13)
    w = words(rng, 80)
    docs = [(5, w), (3, [x.upper() for x in w]), (9, w), (9, w), (20, words(rng, 30) + ["the"] * 60 + words(rng, 30)), (21, words(rng, 10) + ["the"] * 55), (22, words(rng, 30) + ["the"] * 30 + words(rng, 30))]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string").repartition(3)
    got = spans(df)
    assert sorted(g for g in got if g[0] < 20) == [(5, 0, 80, 3, 0, 80), (9, 0, 80, 3, 0, 80)]
    assert {(g[0], g[3]) for g in got if g[0] >= 20} == {(21, 20)}


def test_large_groups_compare_few_pairs(monkeypatch):
    """A line that 300 texts hold, and 300 edited copies of one text: the links of all pairs compared, from few comparisons."""
    rng = np.random.default_rng(14)
    new = lambda n: rng.integers(0, 1 << 32, n).astype(np.uint32)
    line, base, shared, texts, copies = new(30), new(133), new(25), [], []
    for k in range(300):
        texts.append(np.r_[new(51), line, shared if k in (40, 250) else new(25), new(27)])
        x = base.copy()
        for at in rng.choice(np.r_[4:45, 75:125], rng.integers(1, 12), replace=False):
            x[at] = new(1)[0]
        copies.append(x)
    calls = []
    for name in ("_dense", "_aligned"):
        monkeypatch.setattr(substring, name, lambda *a, f=getattr(substring, name): calls.append(1) or f(*a))
    for group, at in ((texts, 60), (copies, 60)):
        calls.clear()
        got = list(substring._partners(list(range(300)), [at] * 300, [0] + [1] * 299, [x.tobytes() for x in group]))
        assert len(calls) < 4000  # all pairs: 44,850
        open_runs: dict = {}
        want = []
        for i, x in enumerate(group):
            left = {s: x[s : s + 25].tobytes() for s in range(at - 16, at - 3)}
            for j in range(i):
                if any(open_runs[j].get(s) == run for s, run in left.items()) and (spans := align(x, group[j])):
                    want.append((i, j))
                    left = {s: run for s, run in left.items() if not any(lo <= s and s + 25 <= hi for lo, hi, *_ in spans)}
            open_runs[i] = left
        assert got == want and got
