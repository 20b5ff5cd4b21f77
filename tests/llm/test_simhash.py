import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from verdimill.llm.graph import connected_components
from verdimill.llm.simhash import covering_masks, fingerprint, near_duplicates, near_links


def slow_fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBc \n\té"), max_size=40))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_masks_cover_every_triple():
    for free in ((1 << 64) - 1, 0xFFFF0000FFFF0000, 0xFF):
        masks = covering_masks(free)
        bits = [b for b in range(64) if free >> b & 1]
        for t in itertools.combinations(bits, 3):
            d = sum(1 << b for b in t)
            assert any(not m & d for m in masks)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = np.array([slow_fingerprint(r.text or "") for r in docs], np.uint64)
    ids = [r.doc_id for r in docs]
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    comp = slow_components(near.tolist(), len(ids))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {ids[i]: (f"{int(fps[i]):016x}", ids[comp[i]]) for i in range(len(ids))}


def test_buckets_beyond_the_limit_are_split_not_cut(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 1500:
        x = rng.choice(tuple(fps)) if rng.random() < 0.5 else centre
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(20)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    arr = np.array(sorted(fps), np.uint64)
    near = np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3)
    want = slow_components(near.tolist(), len(arr))
    nodes = spark.createDataFrame([(i, int(x) - (1 << 64) if int(x) >> 63 else int(x)) for i, x in enumerate(arr)], "node long, fp long")
    got = {r.node: r.component for r in connected_components(near_links(nodes, bucket=256)).collect()}
    assert [got.get(i, i) for i in range(len(arr))] == want


def test_edge_cases(spark):
    df = spark.createDataFrame([(5, None, "a"), (3, "", "b"), (9, " \n", "c"), (None, "x y z", "d"), (7, "X y Z", "e"), (7, "X y Z", "e"), (None, "only here", "f")], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()), key=str)
    f = f"{slow_fingerprint('x y z'):016x}"
    g = f"{slow_fingerprint('only here'):016x}"
    assert got == sorted([(5, "0" * 16, 3), (3, "0" * 16, 3), (9, "0" * 16, 3), (None, f, 7), (7, f, 7), (7, f, 7), (None, g, None)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [1, *range(200, 260)]}}
