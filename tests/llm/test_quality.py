import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from verdimill.llm.quality import MAX_NGRAM_SHARE, measure, quality_rules


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    c = Counter(grams)
    cover = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    shares = {}
    for k in MAX_NGRAM_SHARE:
        seen, inside = set(), set()
        for i in range(n - k + 1):
            g = tuple(words[i : i + k])
            if g in seen:
                inside |= set(range(i, i + k))
            seen.add(g)
        total = sum(map(len, words))
        shares[k] = sum(len(words[i]) for i in inside) / total if total else 0.0
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(cover), "base_failed": n < 50 or 100 * len(cover) > 50 * n, **{f"dup_{k}gram_share": shares[k] for k in shares}}


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "漢", "d#", "\n", "\n\n", "*", "\x1c", " "]), max_size=90), st.sampled_from([" ", "\t", " \n"]))
def test_measure(words, space):
    text = space.join(words)
    got = measure(text.encode())
    for k, v in slow(text).items():
        assert abs(got[k] - v) < 1e-9, k


def test_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, clean), (2, None), (3, ""), (4, "short text"), (5, "\n".join([clean, *[line] * 30])), (6, clean + " " + clean), (None, clean), (1, clean)]
    got = [(r.doc_id, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_words")).collect()]
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (None, True), (1, True)]
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: slow(r.text) for r in docs.collect()}
    for r in quality_rules(docs).collect():
        for k, v in want[r.doc_id].items():
            assert abs(r[k] - v) < 1e-9, (r.doc_id, k)


def test_repeats_in_long_texts():
    body = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(50)]
    short = [x for i, line in enumerate(body) for x in (line, "-- next --")]  # half of the lines, few of the characters
    assert not measure("\n".join(short).encode())["kept"]
    again = [x for i, line in enumerate(body) for x in (line, *([" ".join(body[i - 1].split()[:12]) + f" tail{i}"] if i % 3 == 2 else []))]
    got = measure("\n".join(again).encode())  # a sixth of the characters in repeated 10-grams, no repeated line
    assert 0.10 < got["dup_10gram_share"] < 0.20 and got["n_dup_lines"] == 0 and not got["kept"]
    once = body[:6] + [body[0]]
    assert measure("\n".join(once).encode())["kept"]
