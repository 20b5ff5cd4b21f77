import hashlib
import pathlib
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_bpe import ENC
from verdimill.llm.common import shared_dir
from verdimill.llm.mixing import mix_documents
from verdimill.llm.simhash import near_duplicates
from verdimill.llm.toxicity import fit, score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage, written and read again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert sorted(df.columns) == sorted(COLUMNS)
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_toxicity_drops_what_it_predicts(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in score_documents(stages[0], fit(stages[0], labels)).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    comp = {r.doc_id: r.component_id for r in near_duplicates(stages[1]).collect()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, c in comp.items() if i == c)


def test_no_long_run_is_left_twice(stages):
    """Brute force: no run of 60 words occurs in two texts after the stage, and words that go are repeats."""
    before = {r.doc_id: r.text.split() for r in stages[2].collect()}
    after = {r.doc_id: r.text.split() for r in stages[3].collect()}
    seen = {}
    for i in sorted(after):
        for k in range(len(after[i]) - 59):
            assert seen.setdefault(tuple(w.lower() for w in after[i][k : k + 60]), i) == i
    changed = [i for i in before if before[i] != after.get(i)]
    assert len(changed) < len(before) / 2


def test_mix_repeats_to_its_plan(stages):
    plan = {r.doc_id: (r.size, r.taken) for r in mix_documents(stages[3]).collect()}
    got = defaultdict(int)
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in got.items() if n} == {i: t for i, (_, t) in plan.items() if t}


def test_tokens(stages):
    texts = defaultdict(list)
    for r in stages[4].collect():
        texts[r.doc_id].append(r.text)
    n = 0
    for r in stages[5].collect():
        assert any(list(r.ids) == ENC.encode_ordinary(t) for t in texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in texts[r.doc_id]}
        n += 1
    assert n == sum(map(len, texts.values()))


CLASHES = "score predicted k_id k_n s_id spans _target _taken _source_size g_source _size _cell _copy _copies _last _row _offset _in_cell _o_source _o_cell doc key pos fp node l_id toxic held_out a b tag text_ lo hi words nfp component_id count value label"


@pytest.mark.parametrize("k", range(4))
def test_extra_columns_of_any_name(spark, sf, k):
    """Columns that are called like those a stage uses within change no row and come out as they went in."""
    name, stage = cp.STAGES[k]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in CLASHES.split()})
    plain, wide = stage(spark, docs, sf).collect(), stage(spark, more, sf)
    assert sorted(wide.columns) == sorted(more.columns)
    wide = wide.collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in wide) == sorted(tuple(r[c] for c in COLUMNS) for r in plain)
    assert all(r[c] == f"{c}-{r.doc_id}" for r in wide for c in CLASHES.split())


def test_folders_of_stages_go(spark, sf):
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("stage-*"))
    cp.run(spark, sf)
    assert [p.name.rsplit("-", 1)[0] for p in set(shared.glob("stage-*")) - before] == ["stage-mixing"]


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows pass every stage."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words without id " * 30, "en", None, 510), (3, "same text here", "en", "a", 14), (3, "same text here", "en", "a", 14), (4, "Same text here", "de", "b", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, data in (("full", docs), ("empty", docs.limit(0))):
        d = tmp_path / name
        data.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int").write.parquet(str(d / "labels.parquet"))
        got = [r.doc_id for r in cp.run(spark, str(d)).collect()]
        assert (name == "empty") == (got == [])
