import pytest
from pyspark.sql import functions as F

from verdimill.operators import cache, calibrate, combine, compact, heads, metrics, paths, rank, runs, validate, verdicts
from verdimill.questions import Choice, Condition, Noul, QuestionError, QuestionSet, Score
from verdimill.schemas import ANSWER


def answers(spark, rows, extra):
    """Rows (extra..., answer) from dictionaries with some of ANSWER's members."""
    full = [(*r[:-1], None if r[-1] is None else {k: r[-1].get(k) for k in ("type", "noul", "choice", "score", "confidence", "probs", "legend", "raw", "decode_error")}) for r in rows]
    return spark.createDataFrame(full, f"{extra}, answer {ANSWER}")


def dist(**p):
    return [{"key": k, "p": v} for k, v in sorted(p.items())]


def test_parts_are_weighted_by_lines(spark):
    rows = [
        (1, 1, 2, "1-30", 0, "complete", {"type": "choice", "choice": "good", "confidence": 0.9, "probs": dist(good=0.9, bad=0.1)}),
        (1, 2, 2, "31-40", 0, "complete", {"type": "choice", "choice": "bad", "confidence": 0.5, "probs": dist(good=0.1, bad=0.9)}),
        (2, 1, 2, "1-30", 0, "complete", {"type": "score", "score": 2.0, "confidence": 1.0, "probs": [{"key": "0", "p": 0.0}, {"key": "2", "p": 1.0}]}),
        (2, 2, 2, "31-40", 0, "complete", {"type": "score", "score": 0.0, "confidence": 1.0, "probs": [{"key": "0", "p": 1.0}, {"key": "2", "p": 0.0}]}),
        (3, 1, 2, "", 5, "complete", {"type": "noul", "noul": 0.2}),
        (4, 1, 2, "", 5, "complete", {"type": "noul", "noul": 0.2}),
        (4, 2, 2, "", 5, "failed", None),
        (5, 1, 1, "", 0, "complete", {"type": "noul", "noul": 0.3}),
    ]
    df = answers(spark, rows, "item long, n int, of int, lines string, size int, status string")
    kinds = {"choice": Choice("?", (("good", None), ("bad", None))), "score": Score("?", ("lo", "mid", "hi")), "noul": Noul("?")}
    got = {r.item: r.answer for kind, q in kinds.items() for r in combine.combine_answers(df.where(F.col("answer.type") == kind).unionByName(df.where("answer IS NULL")), "item", q).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1].choice == "good" and [round(p.p, 9) for p in got[1].probs] == [0.3, 0.7] and got[2].score == pytest.approx(1.5) and got[5].noul == 0.3
    best = {r.item: (r.answer.choice, r.where_part) for r in combine.combine_answers(df.where("item = 1"), "item", kinds["choice"], [Condition("bad", ">=", 0.5)]).collect()}
    assert best == {1: ("bad", 2)}
    assert {r.item: r.status for r in combine.item_status(df, "item").collect()} == {1: "complete", 2: "complete", 3: "incomplete", 4: "failed", 5: "complete"}
    err = combine.first_failure(df.withColumn("error", F.lit("down")), "item").collect()
    assert [(r.item, r.error) for r in err] == [(4, "part 2 of 2: down")]


def test_verdict_table(spark):
    y = [Condition("yes", ">=", 0.6)]
    cases = [(0.6, y, [], "flagged"), (0.59, y, [], "near"), (0.4, y, [], "clear"), (0.3, [], y, "unmatched"), (0.7, [], y, "matched"), (0.7, y, y, "flagged"), (0.5, [], [], "near"), (0.9, [], [], "plain"), (0.35, [Condition("no", ">=", 0.6)], [], "flagged")]
    for p, flags, matches, want in cases:
        df = answers(spark, [(1, {"type": "noul", "noul": p})], "i int")
        assert df.select(verdicts.judge(F.col("answer"), flags, matches).alias("v")).first().v == want, (p, want)
    s = answers(spark, [(1, {"type": "score", "score": 1.2})], "i int")
    assert s.select(verdicts.judge(F.col("answer"), [Condition(None, "<=", 1.5)])).first()[0] == "flagged"
    assert s.select(verdicts.judge(F.lit(None).cast(ANSWER), y)).first()[0] is None


def test_validation_order(spark):
    q = Choice("?", (("a", None), ("b", None)))
    ok = {"type": "choice", "choice": "a", "confidence": 0.5, "probs": dist(a=0.6, b=0.4)}
    cases = [
        (None, "missing_answer"), (ok, None), (ok | {"type": "noul"}, "type_mismatch"), (ok | {"confidence": None}, "missing_field"), (ok | {"confidence": float("nan"), "probs": dist(a=9.0, b=0.1)}, "not_finite"),
        (ok | {"confidence": 1 + 1e-7}, None), (ok | {"confidence": 1 + 1e-5}, "out_of_range"), (ok | {"probs": dist(a=1.0)}, "probability_keys"), (ok | {"choice": "c"}, "choice_not_option"),
        (ok | {"choice": "b"}, "choice_not_argmax"), (ok | {"probs": dist(a=0.5, b=0.5), "choice": "b"}, None), (ok | {"probs": dist(a=0.6, b=0.2)}, "probability_sum"), (ok | {"probs": dist(a=0.6, b=0.35)}, None),
    ]
    df = answers(spark, [(i, a) for i, (a, _) in enumerate(cases)], "i int")
    got = {r.i: r.r for r in df.select("i", validate.name(validate.reason(q, F.col("answer"))).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    s = Score("?", ("x", "y", "z"))
    base = {"type": "score", "score": 1.0, "confidence": 0.5, "probs": [{"key": str(i), "p": p} for i, p in enumerate((0.25, 0.5, 0.25))], "legend": [{"key": "1", "label": '"y"'}]}
    more = [(base, None), (base | {"score": 2.14}, "out_of_range"), (base | {"score": -0.1}, None), (base | {"legend": [{"key": "9", "label": ""}]}, "legend_keys"), (base | {"score": float("inf")}, "not_finite")]
    df = answers(spark, [(i, a) for i, (a, _) in enumerate(more)], "i int")
    got = {r.i: r.r for r in df.select("i", validate.name(validate.reason(s, F.col("answer"))).alias("r")).collect()}
    assert [got[i] for i in range(len(more))] == [w for _, w in more]


def test_compaction():
    def seg(size, needed=0.5, short=None, short_size=0, pinned=False, verbatim=None, scored=True):
        return {"size": size, "needed": needed, "short": short, "short_size": short_size, "pinned": pinned, "verbatim": verbatim, "scored": scored}

    r = compact.Rule(100, 0.2, 0.5)
    got = compact.select_one([seg(40, pinned=True), seg(30, 0.9), seg(50, 0.8, "s", 20), seg(10, 0.1), seg(5, scored=False), seg(30, 0.9, "s", 6, verbatim=0.1)], r)
    assert got == [("keep", "pinned"), ("keep", "ranked"), ("drop", "budget"), ("drop", "floor"), ("keep", "unscored"), ("short", "ranked")]
    assert compact.select_one([seg(200, pinned=True), seg(1, scored=False)], r) == [("keep", "pinned"), ("drop", "budget")]
    for bad in ([seg(-1)], [seg(1, 1.5)]):
        with pytest.raises(ValueError):
            compact.select_one(bad, r)


def test_ranks_pairs_and_cycles(spark):
    with pytest.raises(Exception, match="finite"):
        rank.check_observations(spark.createDataFrame([(float("nan"),)], "noul double")).collect()
    items = spark.createDataFrame([(i,) for i in range(3)], "i int")
    circle = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 0, 0.9)], "first int, second int, noul double")
    assert rank.has_cycle(rank.preference_edges(circle)) and rank.missing_pairs(items, "i", circle).count() == 0
    line = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.5)], "first int, second int, noul double")
    assert not rank.has_cycle(rank.preference_edges(line))
    assert rank.duplicate_pairs(circle.unionByName(spark.createDataFrame([(1, 0, 0.1)], circle.schema))).count() == 1
    many = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7 / 7).alias("v"), F.lit("").alias("k"), F.lit(1).alias("size"))
    pos = rank.rerank(many, "v", "k", "i")
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r.i for r in pos.orderBy("position").collect()] == want and pos.agg(F.max("position")).first()[0] == 1000
    assert rank.select_under_budget(pos, "position", "size", 333, digits=10).count() == 333


def test_heads(spark):
    plan = heads.Plan(Choice("?", (("a", None), ("b", None))), {"a": {"x": Noul("?")}, "b": {}})
    rows = plan.attach(QuestionSet(), "sel")
    assert rows == [("sel", "a", "x", "sel.1:a.x")]
    with pytest.raises(QuestionError):
        heads.Plan(Choice("?", (("a", None),)), {"b": {}})
    branches = spark.createDataFrame(rows, heads.BRANCHES)
    sel = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "i int, choice string")
    ans = spark.createDataFrame([(1, "sel.1:a.x", "v", None), (2, "sel.1:a.x", "v", "not_finite"), (3, "sel.1:a.x", "v", "not_finite")], "i int, question string, answer string, reason string")
    got = {r.i: (r.answer, r.error) for r in heads.read(sel, ans, branches, ["i"]).collect()}
    assert got == {1: ("v", None), 2: (None, "not_finite"), 3: (None, "unknown selected option z")}
    assert {(r.i, r.selected) for r in heads.diagnostics(sel, ans, branches, ["i"]).collect()} == {(2, True), (3, False)}


def test_cache_files(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("k", "", 1, {"type": "noul", "noul": 0.1}), ("k", "v1", 2, {"type": "noul", "noul": 0.2}), ("m", "v2", 3, {"type": "noul", "noul": 0.3})]
    e = answers(spark, rows, "key string, version string, time_ns long")
    assert cache.entries(spark, path).count() == 0
    assert [cache.append(e, path), cache.append(e.where("key = 'm'"), path)] == [1, 2]
    assert not cache.compact(spark, path) and cache.compact(spark, path, 1)
    got = cache.entries(spark, path)
    assert {(r.key, r.answer.noul, r.segment_seq) for r in got.collect()} == {("k", 0.2, 3), ("m", 0.3, 3)}
    assert not cache.compact(spark, path, 1)
    assert [r.key for r in cache.usable(got).collect()] == ["m"]  # k was answered by an older version


def test_calibration(spark):
    rows = [(i, v, v, not h, h) for i, (v, h) in enumerate([(0.9, True), (0.8, False), (0.7, True), (0.4, False)])]
    c = spark.createDataFrame(rows, "id int, value double, p double, wrong boolean, hit boolean")
    assert [(r.cutoff, r.allowed, r.errors) for r in calibrate.sweep(c).orderBy(F.desc("cutoff")).collect()] == [(0.9, 1, 0), (0.8, 2, 1), (0.7, 3, 1), (0.4, 4, 2)]
    assert [(r.cutoff, r.allowed) for r in calibrate.sweep(c, risky=True).orderBy("cutoff").collect()] == [(0.4, 1), (0.7, 2), (0.8, 3), (0.9, 4)]
    assert calibrate.best(calibrate.sweep(c), calibrate.Config(0.0)).first().cutoff == 0.9
    assert calibrate.best(calibrate.sweep(c), calibrate.Config(0.0, 2)).first() is None
    held = c.withColumn("id", F.col("id") + 10)
    a = calibrate.fit(c, held, calibrate.Config(0.4, temperatures=(4.0,)), ["id", "hit"])
    assert a.cutoff == 0.7 and calibrate.Artifact.from_json(a.to_json()).to_json() == a.to_json() and a.fit_digest != a.heldout_digest
    assert calibrate.digest(c, ["id"]).first() == calibrate.digest(c.orderBy(F.desc("id")), ["id"]).first()
    with pytest.raises(calibrate.CalibrationError):
        calibrate.fit(c, c, calibrate.Config(0.4), ["id"])
    d = calibrate.compare({"coverage": 0.9, "brier": 0.1}, {"coverage": 0.7, "brier": 0.05}, {"coverage": 0.1, "brier": 0.0})
    assert d["coverage"]["exceeded"] and not d["brier"]["exceeded"]


def test_metrics(spark):
    df = spark.createDataFrame([("g", 0.9, 1), ("g", 0.5, 1), ("g", 0.5, 0), ("g", 0.1, 0), ("h", 0.2, 1)], "g string, s double, y int")
    assert {r.g: r.auc for r in metrics.auc(df, "s", "y", ["g"]).collect()} == {"g": 0.875, "h": None}
    assert metrics.best_threshold(df, "s", "y").first().threshold == 0.15


def test_call_graphs(spark):
    edges = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "sink"), ("c", "sink"), ("x", "y"), ("b", "a")], "caller string, callee string")
    sinks = spark.createDataFrame([("sink",)], "node string")
    got = {r.node: (r.distance, r.chain) for r in paths.reaches(edges, sinks, 5).collect()}
    assert got["main"] == (3, ["main", "a", "b", "sink"]) and "x" not in got
    assert {r.node for r in paths.forwarders(sinks, edges.where("caller = 'b' OR caller = 'a'")).collect()} == {"sink", "b", "a"}
    sites = spark.createDataFrame([("s1", "sink")], "site string, node string")
    ends = spark.createDataFrame([("main",), ("c",)], "node string")
    assert [(r.path, r.length) for r in paths.bounded_paths(edges, sites, ends, 4, 2).orderBy("length").collect()] == [(["c", "sink"], 1), (["main", "a", "b", "sink"], 3)]
    calls = spark.createDataFrame([("f", "sink", 1, 2, 2, 0), ("g", "sink", 2, 2, 1, 0)], "caller string, callee string, line int, n_inputs int, n_constant int, n_forwarded int")
    assert [r.caller for r in paths.sink_sites(calls, sinks).collect()] == ["g"]
    assert paths.render_path(["f\n" + "x" * 50, "g\n" + "y" * 500, "h\n" + "z" * 50], 200).count("...") == 1 and paths.render_path(["x" * 99], 5) is None


def test_streaks_and_exit_codes(spark):
    e = spark.createDataFrame([("u", i, x) for i, x in enumerate(["e", "e", None, "e", "e", "e", "f"])], "u string, at int, error string")
    assert [(r.first, r.last, r.n) for r in runs.error_streaks(e, "at", "error", ["u"], 3).collect()] == [(3, 5, 3)]
    assert [runs.exit_code(s, f) for s, f in (({"failed": 1}, None), ({"flagged": 2}, "flagged"), ({"flagged": 2}, None), ({}, "flagged"))] == [1, 2, 0, 0]
