import datetime
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from verdimill import sinks, store
from verdimill.engine import Engine, EngineConfig
from verdimill.functions.text import ago, wrap
from verdimill.operators import calibrate, checks, compact, funnel, metrics, paths, rank, runs
from verdimill.questions import Choice, Noul, Template
from verdimill.remote import WireScorer
from verdimill.scorers import CallError, HashScorer, Retry, Scorer, UniformScorer, retry_after, score, with_retry
from verdimill.sources import diff, files, media


class Refused(Scorer):
    def ask(self, state, questions):
        raise CallError("no such key", 401)


def test_refused_credentials_stop_at_once(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6)], "i long, state string").coalesce(1)
    got = [r.error for r in score(df, {"q": Noul("?")}, Refused(), workers=1).orderBy("i").collect()]
    assert got[0].startswith("refused: ") and all(e.startswith("not asked: ") for e in got[1:])


def test_attempts_and_waits():
    now = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
    assert retry_after("7") == 7 and retry_after("Wed, 01 May 2024 00:00:30 GMT", now) == 30 and retry_after("Tue, 30 Apr 2024 00:00:00 GMT", now) == 0 and retry_after("soon") is None
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        with_retry(lambda: time.sleep(3), Retry(retries=1, attempt=0.1), lambda s: None)
    assert time.monotonic() - began < 2
    waits = []
    with pytest.raises(CallError):
        with_retry(lambda: (_ for _ in ()).throw(CallError("busy", 503)), Retry(), waits.append, lambda: 1.0)
    assert waits == [0.375, 0.75]


def test_a_run_has_one_writer(spark, tmp_path):
    root = str(tmp_path / "runs")
    t = Template("t", {"q": Noul("?")}, {"q": "yes"})
    data = tmp_path / "d.txt"
    data.write_text("a\nb\n")
    e = Engine(spark, EngineConfig(runs_dir=root))
    r = e.run(t, [str(data)]).run
    assert (r.complete, r.failed, r.status) == (2, 0, "complete")
    with r.writing(spark):
        with pytest.raises(runs.RunBusy):
            e.resume(r.id, t)
        with r.writing(spark, stale=-1.0):  # the other writer died long ago
            pass
    e.resume(r.id, t)
    broken = runs.Run("x", root)
    with pytest.raises(Exception):
        broken.create(spark.range(1).select(F.raise_error(F.lit("no")).alias("a")))
    assert [x.id for x in e.runs()] == [r.id] and store.names(spark, root) == [r.id]


def test_files_passed_over_are_listed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n")
    (tmp_path / "b.bin").write_bytes(b"\0" * 20)
    (tmp_path / "c.md").write_text("x" * (files.MAX_TEXT + 1))
    t = Template("t", {"q": Noul("?")}, {"q": "yes"})
    r = Engine(spark).run(t, [str(tmp_path)])
    assert r.summary["items"] == 1 and {(x.label.rsplit("/")[-1], x.reason) for x in r.skipped.collect()} == {("b.bin", "binary file"), ("c.md", "too large")}
    with pytest.raises(files.SourceError):
        files.scan(spark, [str(tmp_path / "b.bin")])


def test_lines_of_large_files(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    lines = [json.dumps({"i": i, "t": "é" * (i % 50)}) if i % 7 else "" for i in range(5000)]
    path.write_text("\r\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_lines(spark, [str(path)], "jsonl").select("line", "value", "label").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in got) == [(n, x) for n, x in enumerate(lines, 1) if x]
    assert all(r.label.endswith(f"big.jsonl:{r.line}") for r in got)
    path.write_text("{}\nno")
    with pytest.raises(Exception, match="not JSON"):
        files.read_lines(spark, [str(path)], "jsonl").collect()


def test_paths_go_on_to_the_outermost_entry(spark):
    edges = spark.createDataFrame([("main", "b"), ("b", "c"), ("web", "b"), ("c", "d"), ("d", "c"), ("cron", "main")], "caller string, callee string")
    functions = spark.createDataFrame([("main", ["*http.Request"], []), ("web", [], ["http.Request"]), ("cron", ["int"], None), ("b", None, None)], "node string, parameters array<string>, embeds array<string>")
    entries = paths.entry_points(functions, ["http.Request"])
    assert sorted(r.node for r in entries.collect()) == ["main", "web"]
    start = spark.createDataFrame([("s", ["c", "d"]), ("t", ["cron"])], "site string, path array<string>")
    got = {r.site: r.path for r in paths.to_outermost(start, edges, entries, 5).collect()}
    assert got == {"s": ["main", "b", "c", "d"], "t": ["cron"]}


def test_labels_join_by_suffix(spark):
    scored = spark.createDataFrame([("a/src/x.ts", "User.find", 0.9), ("b/src/x.ts", "find", 0.8), ("a/src/yx.ts", "find", 0.1)], "path string, function string, p double")
    labels = spark.createDataFrame([("src/x.ts", "find", 1), ("a/src/x.ts", "User.find", 2), ("x.ts", "Other.find", 3)], "suffix string, name string, label int")
    got = sorted((r.path, r.function, r.label) for r in metrics.label_scores(scored, labels).collect())
    assert got == [("a/src/x.ts", "User.find", 1), ("a/src/x.ts", "User.find", 2), ("b/src/x.ts", "find", 1)]


def test_runs_join_and_positions(spark):
    a = spark.createDataFrame([("s", "i", 0.5), ("s", "j", 0.1)], "source string, input string, p double")
    b = spark.createDataFrame([("s", "i", 0.25)], "source string, input string, p double")
    d = metrics.run_difference(metrics.join_runs(a, b, "p"), "a", "b").first()
    assert (d.n, d.mean_diff, d.n_large) == (1, 0.25, 1)
    ranked = spark.createDataFrame([(i, i + 1) for i in range(8)], "id long, position long")
    got = rank.positions_of(ranked, spark.createDataFrame([(3,), (99,)], "id long"), "position", ["id"]).collect()
    assert {(r.id, r.position, r.percentile) for r in got} == {(3, 4, 0.5), (99, None, None)}


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(("a", None)[i % 5 == 0], i % 13, int(i % 3 == 0)) for i in range(400)], "g string, v long, y int").repartition(4)
    rows = df.collect()
    got = {(r.g, r.v): r.r for r in metrics.average_ranks(df.where("g = 'a'"), "v", ["g"], "r").collect()}
    values = sorted(r.v for r in rows if r.g == "a")
    for (_, v), r in got.items():
        assert r == values.index(v) + (values.count(v) + 1) / 2
    for r in metrics.auc(df, "v", "y", ["g"]).collect():
        p, q = ([x.v for x in rows if x.g == r.g and x.y == y] for y in (1, 0))
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
        assert r.auc == pytest.approx(want)


def test_cycles(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src int, dst int")
    assert not rank.has_cycle(edges((1, 2), (2, 3), (1, 3)))  # a full sort
    assert rank.has_cycle(edges((1, 2), (2, 3), (3, 1)))
    assert not rank.has_cycle(edges((1, 2), (3, 4), (2, 4)))
    assert rank.has_cycle(edges((1, 2), (2, 1), (5, 1), (1, 6))) and rank.has_cycle(edges((1, 1))) and not rank.has_cycle(edges((1, 2)).limit(0))


def test_cohorts_and_cases(spark):
    rows = [(i, f"s{i}", i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, state string, hit int")
    one = lambda d: calibrate.digest(d, ["id", "state", "hit"]).first()[0]
    assert one(df) == one(df.repartition(7)) != one(df.where("id > 0")) and len(one(df.limit(0))) == 64
    case = lambda **p: [{"key": k, "p": v} for k, v in sorted(p.items())]
    make = lambda *r: spark.createDataFrame(list(r), "id int, label string, probs array<struct<key:string,p:double>>")
    calibrate.check_cases(make((1, "a", case(a=0.4, b=0.6)), (2, "b", case(a=0.5, b=0.52))), ["a", "b"])
    for bad in ((1, "c", case(a=0.4, b=0.6)), (1, "a", case(a=1.0)), (1, "a", case(a=0.4, b=0.9)), (1, "a", case(a=float("nan"), b=0.6)), (1, None, case(a=0.4, b=0.6)), (1, "a", None)):
        with pytest.raises(calibrate.CalibrationError):
            calibrate.check_cases(make(bad), ["a", "b"])
    with pytest.raises(calibrate.CalibrationError):
        calibrate.check_cases(make((1, "a", case(a=0.4, b=0.6)), (1, "a", case(a=0.4, b=0.6))), ["a", "b"])


def test_adjusted_metrics(spark):
    c = spark.createDataFrame([(0.9, 0.9, False, True), (0.8, 0.8, True, False)], "value double, p double, wrong boolean, hit boolean")
    m = calibrate.metrics(c, 0.5, calibrate.Config(0.5), 2.0).first()
    cold = [p**0.5 / (p**0.5 + (1 - p) ** 0.5) for p in (0.9, 0.8)]
    assert m.adjusted_brier == pytest.approx(((1 - cold[0]) ** 2 + cold[1] ** 2) / 2) and m.brier == pytest.approx((0.01 + 0.64) / 2)
    same = calibrate.metrics(c, 0.5, calibrate.Config(0.5)).first()
    assert (same.adjusted_brier, same.adjusted_ece) == (same.brier, same.ece)


def test_small_functions(spark, tmp_path):
    assert wrap("a bb ccc\n\nlongerword x", 5) == ["a bb", "ccc", "", "longerword", "x"] and wrap("", 5) == [""]
    path = tmp_path / "f"
    path.write_bytes(b"x" * 3_000_001)
    assert media.file_hash(str(path)) == hashlib.sha256(path.read_bytes()).hexdigest()
    asked = spark.createDataFrame([("m", 5, 2, None), ("", 3, 1, None), ("m", 9, 9, "down")], "model string, request_tokens long, answer_tokens long, error string")
    assert tuple(funnel.usage(asked, "s").first()) == ("s", 2, 8, 3, ["m"], True)
    s = HashScorer()
    got = score(spark.createDataFrame([("x", ["b"])], "state string, w array<string>"), {"a": Noul("?"), "b": Noul("?")}, s, only="w").first()
    assert set(got.answers) == {"b"}


class Down(Scorer):
    """A service that is down for all, which counts its calls."""

    remote = True

    def __init__(self, log):
        self.log = str(log)

    def ask(self, state, questions):
        with open(self.log, "a") as f:
            f.write(".")
        raise CallError("down", 400)


def test_a_run_stops_asking_when_the_first_items_fail(spark, tmp_path):
    data = tmp_path / "d.txt"
    data.write_text("\n".join(f"line {i}" for i in range(60)))
    t = Template("t", {"q": Noul("?")}, {"q": "yes"})
    r = Engine(spark, EngineConfig(scorer=Down(tmp_path / "log"), workers=1, parallelism=6)).run(t, [str(data)])
    assert (tmp_path / "log").read_text() == "." * 5 and r.summary["failed"] == 60 and r.exit_code == 1
    assert sum("not asked" in x.error for x in r.items.collect()) == 55


def test_checks_fail_open():
    now = [0.0]

    class Sometimes(Scorer):
        fine = False

        def ask(self, state, questions):
            if not self.fine:
                raise CallError("down", 503)
            return {"a": {"type": "noul", "noul": 0.7}, "b": {"type": "noul", "noul": 0.9}, "c": {"type": "noul", "noul": 0.1}}

    s = Sometimes()
    c = checks.Checker(s, {k: Noul("?") for k in "abc"}, clock=lambda: now[0])
    assert c.check("command", "x")["error"] == "CallError: down" and c.check("command", "x")["error"] == "paused"
    now[0] = 6.0
    assert c.check("command", "x")["error"] == "CallError: down" and c.closed_until == 16.0
    now[0], s.fine = 17.0, True
    assert c.check("content", "x") == {"checked": True, "flags": [("b", 0.9), ("a", 0.7)], "error": None} and c.pause == 0


def test_compaction_end_to_end(spark):
    rows = [(1, 0, "sys", True), (1, 1, "word " * 30, False), (1, 2, "other " * 30, False), (2, 0, "x" * 5000, False)]
    seg = spark.createDataFrame(rows, "conv long, turn int, text string, pinned boolean")
    size = F.length("text")
    seg = seg.withColumns({"size": size, "short_size": F.lit(5), "short": F.lit("short")})
    decisions, per, whole = compact.compact(seg, "conv", "turn", compact.Rule(400), UniformScorer(), "size", 1000)
    got = {(r.conv, r.turn): (r.action, r.cause) for r in decisions.collect()}
    assert got == {(1, 0): ("keep", "pinned"), (1, 1): ("keep", "ranked"), (1, 2): ("keep", "ranked"), (2, 0): ("short", "unscored")}
    assert {(r.conv, r.before, r.after) for r in per.collect()} == {(1, 333, 333), (2, 5000, 5)}
    w = whole.first()
    assert (w.before, w.after, w.requests, w.failed, w.models, w.tokens) == (5333, 338, 1, 0, ["uniform-1"], 330)


def test_printing_and_summary_files(spark, tmp_path):
    data = tmp_path / "d.txt"
    data.write_text("a\nb\n")
    t = Template("t", {"q": Choice("?", (("x", None), ("y", None)))}, {"q": "x >= 1%"})
    r = Engine(spark).run(t, [str(data)])
    lines = list(sinks.print_items(r.items, t.questions, full=True))
    assert len(lines) == 8 and sum("[flagged]" in x for x in lines) == 2 and sum(x.startswith("    x ") or x.startswith("    y ") for x in lines) == 4
    path = str(tmp_path / "summary.md")
    for _ in range(2):
        sinks.append_summary(spark, r.items, t.questions, "Title", path)
    assert open(path).read().count("# Title") == 2
    assert [ago(x) for x in (3, 60, 7300, 200_000)] == ["just now", "1 minute ago", "2 hours ago", "2 days ago"]


def test_files_on_disk_are_compared_with_the_diff(tmp_path):
    f = diff.File("a.py", "a.py", hunks=[diff.Hunk("@@ -1,2 +1,2 @@", "", 1, 1, [" x", "-y", "+z"])])
    (tmp_path / "a.py").write_text("x\nz\n")
    assert diff.is_new_side(f, str(tmp_path))
    (tmp_path / "a.py").write_text("x\ny\n")
    assert not diff.is_new_side(f, str(tmp_path))
    assert not diff.is_new_side(diff.File("../a.py", "../a.py"), str(tmp_path / "sub"))


def test_scorers_over_a_transport():
    sent = []

    def transport(body):
        sent.append(json.loads(body))
        if len(sent) == 1:
            return 429, {"Retry-After": "3"}, ""
        return 200, {}, json.dumps({"model": "m-2", "answers": {"a": {"type": "noul", "noul": 0.25}}})

    s = WireScorer(transport, "m")
    with pytest.raises(CallError) as e:
        s.ask("x", {"a": Noul("?")})
    assert (e.value.status, e.value.after) == (429, 3.0)
    assert s.ask("x", {"a": Noul("?")})["a"]["noul"] == 0.25 and s.reported == "m-2" and sent[1]["state"] == "x"
    assert s.ask_media("x", [("image/png", b"abc")], {"a": Noul("?")})["a"]["noul"] == 0.25 and sent[2]["state"][1]["data"] == "YWJj"


def test_benchmark_items(spark):
    cases = spark.createDataFrame([(1, "a.java", "A"), (2, "b.java", "B"), (3, "c.java", "C")], "case int, path string, content string")
    labels = spark.createDataFrame([(1, "sqli", True), (2, "xss", False)], "case int, category string, real boolean")
    uses = spark.createDataFrame([(1, "z"), (1, "h"), (1, "h")], "case int, helper string")
    helpers = spark.createDataFrame([("h", "H"), ("z", "Z")], "helper string, content string")
    got = {r.case: (r.category, r.real, json.loads(r.state)) for r in metrics.bench_items(cases, labels, uses, helpers).collect()}
    assert got == {1: ("sqli", True, {"path": "a.java", "content": "A", "called": [{"path": "h", "content": "H"}, {"path": "z", "content": "Z"}]}), 2: ("xss", False, {"path": "b.java", "content": "B"})}
