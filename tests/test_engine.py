import json
import os

import pytest
from pyspark.sql import functions as F

from verdimill import sinks, templates
from verdimill.engine import Engine, EngineConfig, ask_one, judge, pick_one
from verdimill.operators import cache, gate, pick
from verdimill.questions import Choice, Condition, Noul, QuestionError, QuestionSet, Score, Template, decode, encode, parse_condition
from verdimill.scorers import CallError, HashScorer, Retry, Scorer, TableScorer, UniformScorer, hash_answers, retryable, score, with_retry
from verdimill.sources import code, diff, files, markdown, media, split
from verdimill.streaming import collector


def test_conditions():
    assert parse_condition("yes", "noul") == Condition("yes", ">=", 0.6)
    assert parse_condition("no >= 80%", "noul") == Condition("no", ">=", 0.8)
    assert parse_condition("<= 1.5", "score") == Condition(None, "<=", 1.5)
    assert parse_condition("very negative > 5%", "choice") == Condition("very negative", ">", 0.05)
    for bad, kind in (("", "noul"), ("yes >= 101%", "noul"), ("a < 5%", "choice"), ("1.5", "score"), ("yes >= 1.2.3%", "noul")):
        with pytest.raises(QuestionError):
            parse_condition(bad, kind)


def test_questions_round_trip():
    for q in (Noul("a?", true="t", extra={"z": 1}), Choice("b?", (("x", None), ("a", "d"))), Score("c?", ("lo", "hi"))):
        assert decode(encode(q)) == q
    assert list(json.loads(encode(Choice("b?", (("x", 1), ("a", 2)))))["criteria"]) == ["x", "a"]
    s = QuestionSet()
    s.ask("k", Noul("?"))
    for key, q in (("k", Noul("?")), ("", Noul("?")), ("s", Score("?", ("one",))), ("c", Choice("?"))):
        with pytest.raises(QuestionError):
            s.ask(key, q)


def test_templates(tmp_path):
    assert len(templates.BUILTIN) == 12
    for t in templates.BUILTIN.values():
        assert Template.from_json(t.to_json()).conditions("flags") == t.conditions("flags")
    with pytest.raises(QuestionError):
        templates.load("relevance").with_params()
    filled = templates.load("relevance").with_params(question="why?")
    assert filled.questions["relevant"].instructions.endswith("why?")
    path = templates.create("mine", str(tmp_path))
    (tmp_path / "bad.json").write_text("{}")
    found, broken = templates.catalogue([str(tmp_path)])
    assert "mine" in found and len(broken) == 1 and os.path.exists(path)


def test_scorers_agree(spark):
    qs = templates.load("triage").questions | {"mood": Choice("?", (("b", None), ("a", None)))}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", "abc", "é漢", "x" * 5000])], "i long, state string")
    cols = {r.i: r for r in hash_answers(df, qs).collect()}
    for r in score(df, qs, HashScorer()).collect():
        c = cols[r.i]
        assert r.answers["urgent"].noul == c.urgent.noul and r.answers["mood"].choice == c.mood.choice
        assert [p.p for p in r.answers["mood"].probs] == [p.p for p in c.mood.probs]
        assert r.answers["impact"].score == pytest.approx(c.impact.score, abs=1e-12)
    assert ask_one("abc", Noul("?"), UniformScorer())["noul"] == 0.5
    assert pick_one("s", "?", ["a", "b"]) in ("a", "b", None)
    assert judge(spark, ["a", "b"], {"q": Noul("?")}).count() == 2


class Flaky(Scorer):
    model = "flaky"

    def ask(self, state, questions):
        if state.startswith("bad"):
            raise CallError("down", 400)
        return HashScorer().ask(state, questions)


def test_errors_retries_and_breaker(spark):
    df = spark.createDataFrame([(i, "bad" if i > 3 else f"s{i}") for i in range(12)], "i long, state string").coalesce(1)
    rows = sorted(score(df, {"q": Noul("?")}, Flaky(), workers=1).collect(), key=lambda r: r.i)
    assert [r.error is None for r in rows[:4]] == [True] * 4 and "down" in rows[4].error
    assert [r.error.startswith("not asked") for r in rows[4:]] == [False] * 5 + [True] * 3
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise CallError("busy", 503)
        return {"ok": 1}

    assert with_retry(call, Retry(), waits.append, lambda: 0.0) == {"ok": 1} and waits == [0.5, 1.0]
    assert retryable(TimeoutError()) and not retryable(CallError("", 401)) and retryable(CallError("", 429))
    assert Retry().delay(10, 1.0) == 5 * 0.75


def test_run_store_resume_and_sinks(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "t.jsonl").write_text("\n".join(json.dumps({"id": i, "body": f"text {i}"}) for i in range(12)) + "\n\n")
    t = templates.load("triage")
    plain = Engine(spark).run(t, [str(data)])
    assert plain.summary["items"] == 12 and plain.summary["failed"] == 0
    stored = Engine(spark, EngineConfig(runs_dir=str(tmp_path / "runs")))
    r = stored.run(t, [str(data)], fail_on="flagged")
    assert r.exit_code == (2 if r.summary["flagged"] else 0)
    again = stored.resume(r.run.id[:12], t)
    key = lambda df: sorted((x.item_index, x.urgent.noul, x.flagged) for x in df.select("item_index", "urgent", "flagged").collect())
    assert key(again.items) == key(plain.items) == key(r.items)
    assert [x.id for x in stored.runs()] == [r.run.id]
    items = r.items
    assert len(sinks.json_rows(items.drop("urgent", "impact")).collect()) == 12
    cells = sinks.csv_cells(items, t.questions)
    assert cells.columns == ["source", "status", "flagged", "matched", "urgent", "impact", "error"]
    report = sinks.markdown_report(items, t.questions, "Report")
    assert report.startswith("# Report") and "| Source | urgent | impact | Error |" in report
    for line in sinks.annotations(items, t.questions).collect():
        assert line.value.startswith("::warning file=") and ",line=" in line.value
    assert len(list(sinks.print_items(items, t.questions))) == 36
    assert Engine(spark).view(r, 3).count() == 3
    dry = Engine(spark).dry_run(t, [str(data)])
    assert dry["by_unit"] == {"record": 12} and dry["to_ask"] == 24


def test_parts_of_long_items(spark, tmp_path):
    long = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(40))
    (tmp_path / "a.md").write_text(long)
    items = files.read_items(spark, [str(tmp_path / "a.md")], files.Options(budget=4096))
    row = items.first()
    assert len(row.parts) > 3 and all(split.json_size(json.loads(p.state)["content"]) <= 4096 for p in row.parts)
    r = Engine(spark).run("triage", items)
    assert r.summary == {"items": 1, "failed": 0, "left": 0, "flagged": r.summary["flagged"], "matched": 0, "cached": 0}


def test_sources(spark, tmp_path):
    (tmp_path / "tickets.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "array.json").write_text('["x","y"]')
    (tmp_path / "notes.txt").write_text("first\n\nsecond\n")
    (tmp_path / "export.json").write_text('{"data":{"tickets":[{"body":"a"},{"body":"b"}]}}')
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    os.chdir(tmp_path)
    at = lambda name, **o: [(r.label, r.state) for r in files.read_items(spark, [name], files.Options(**o)).collect()]
    assert at("tickets.jsonl") == [("tickets.jsonl:1", '{"id": 1}'), ("tickets.jsonl:3", '{"id": 2}')]
    assert at("array.json") == [("array.json[0]", '"x"'), ("array.json[1]", '"y"')]
    assert at("notes.txt") == [("notes.txt:1", '"first"'), ("notes.txt:3", '"second"')]
    assert [s for _, s in at("export.json", items="data.tickets", field="body")] == ['"a"', '"b"']
    assert [s for _, s in at("export.json", items="/data/tickets", field="/body")] == ['"a"', '"b"']
    assert [s for _, s in at("t.csv")] == ['{"a":"1","b":"x\\ny"}', '{"a":"2","b":"z"}']
    with pytest.raises(Exception, match="no field 'nope'; available: body"):
        at("export.json", items="data.tickets", field="nope")
    lines = tmp_path / "many.txt"
    lines.write_text("\n".join("x" * i for i in range(1, 101)))
    assert [x for x, _ in at("many.txt", limit=3)] == ["many.txt:1", "many.txt:2", "many.txt:3"]
    some = at("many.txt", sample=5)
    assert len(some) == 5 and some == sorted(some, key=lambda x: int(x[0].split(":")[1])) and some == at("many.txt", sample=5)
    assert files.sniff("a\nb") == "lines" and files.sniff('{"a":1}\n{"a":2}') == "jsonl" and files.sniff("[2024] log line") == "lines"


def test_listing_and_ignores(tmp_path):
    for name in ("a.py", "b.txt", ".hidden", "sub/c.py", "sub/gen/d.py", "skip/e.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n*.txt\n!keep.txt\n")
    (tmp_path / "sub" / ".gitignore").write_text("/gen\n")
    rel = lambda **o: [os.path.relpath(p, tmp_path) for p in files.list_files(str(tmp_path), files.Options(**o))]
    assert rel() == ["a.py", "sub/c.py"]
    assert rel(include=("sub/**",)) == ["sub/c.py"] and rel(exclude=("a.*",)) == ["sub/c.py"]
    assert files.labels(["/x/a/f.py", "/x/b/f.py"], "/w") == {"/x/a/f.py": "a/f.py", "/x/b/f.py": "b/f.py"}


def test_markdown_and_splits():
    lines = "---\nt: 1\n---\n# A\ntext\n\n- item\n  more\n\n```\n# no\n```\n## B\n## B\nlast\n".split("\n")
    assert [(b.kind, b.start, b.end) for b in markdown.blocks(lines)] == [("meta", 1, 3), ("heading", 4, 4), ("text", 5, 5), ("text", 7, 8), ("code", 10, 12), ("heading", 13, 13), ("heading", 14, 14), ("text", 15, 15)]
    assert [(s.anchor, s.start, s.end, s.path) for s in markdown.sections(lines)] == [("a", 5, 12, ("A",)), ("b-1", 15, 15, ("A", "B"))]
    parts = split.split(["a" * 50] * 10 + [""] + ["b" * 300], 120)
    assert "".join(t.replace("\n", "") for *_, t in parts) == "a" * 500 + "b" * 300
    assert all(split.json_size(t) <= 120 for *_, t in parts)


DIFF = """commit 1234567abc
diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def f():
 def f():
-    return 1
+    y = 2
+    return y
 # end
diff --git a/go.sum b/go.sum
--- a/go.sum
+++ b/go.sum
@@ -1 +1 @@
-a
+b
diff --git a/old.txt b/new.txt
rename from old.txt
rename to new.txt
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_diffs(spark):
    assert diff.is_diff(DIFF) and not diff.is_diff("- a\n- b")
    found, _ = diff.parse(DIFF)
    assert [(f.path, f.change, f.skip_reason()) for f in found] == [("x.py", "modified", ""), ("go.sum", "modified", "lockfile"), ("new.txt", "renamed", "renamed only"), ("gone", "deleted", "deleted")]
    hunks = diff.read_hunks(spark, spark.createDataFrame([(DIFF,)], "value string"))
    assert [(r.name, r.line, r.text) for r in diff.added_lines(hunks).orderBy("line").collect()] == [("x.py", 2, "    y = 2"), ("x.py", 3, "    return y")]
    new = spark.createDataFrame([("x.py", "def f():\n    y = 2\n    return y\n# end\n")], "path string, text string")
    assert [(r.name, r.function, r.line) for r in diff.changed_functions(hunks, new).collect()] == [("x.py", "f", 2)]
    assert [r.label for r in files.read_items(spark, [], files.Options(), stdin=DIFF).collect()] == ["x.py:2"]


def test_functions():
    names = lambda p, s: [f.name for f in code.functions(p, s)]
    assert names("a.py", "@d\ndef a(): pass\nclass B:\n  def m(self): pass\nif 1:\n  def c(): pass\n") == ["a", "B.m", "c"]
    assert names("a.go", "package a\nfunc A() {}\nfunc (s *S) B(x int) (int, error) {\n\treturn 1, nil\n}\n") == ["A", "S.B"]
    assert names("a.js", "function a() {}\nclass B { m() { return {} } }\nconst c = () => {\n}\n") == ["a", "B.m", "c"]
    assert names("A.java", "class A { A() {} int m(int x) { return x; } }") == ["A.A", "A.m"]
    assert code.functions("a.py", "def (") is None and code.functions("a.go", "func (") is None and code.functions("a.txt", "") is None


def test_media():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (30).to_bytes(4, "big") + (20).to_bytes(4, "big")
    assert media.sniff(png) == "image/png" and media.dimensions(png) == (30, 20)
    assert media.reason("a.png", png, 100) == "" and media.reason("a.jpg", b"text", 4) == "not image/jpeg"
    assert media.is_binary(b"a\0b") and not media.is_binary("plain é\n".encode()) and media.is_binary(b"PK\x03\x04")
    assert media.kind("image/jpg; q=1") == "image"


def test_pick_keys():
    assert pick.derive_keys(["a", "a", " b\t c ", "x" * 65, "none", ""]) == [("a", None), ("a (2)", "a"), ("b c", " b\t c "), ("c4", "x" * 65), ("none (2)", "none"), ("c6", "")]


def test_gate_rules(spark):
    with pytest.raises(gate.RuleError):
        gate.rule_from_json('{"type":"bands","input":"a","measure":"noul","allow":0.2,"review":0.4}')
    with pytest.raises(gate.RuleError):
        gate.rule_from_json('{"type":"bands","input":"a","measure":"noul","allow":0.5,"review":0.4,"x":1}')
    df = spark.createDataFrame([(0.7,), (0.4,), (0.39,), (float("nan"),), (None,), (1.0000001,)], "p double")
    a = gate.gate_input(F.when(F.col("p").isNotNull(), F.struct(F.lit("noul").alias("type"), F.col("p").alias("noul"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<struct<key:string,p:double>>").alias("probs"), F.lit(None).cast("string").alias("decode_error"))))
    got = df.select(gate.Bands("a", "noul", 0.7, 0.4, on_missing="review").evaluate({"a": a}).alias("d")).select("d.*").collect()
    assert [r.outcome for r in got] == [1, 2, 3, 2, 2, 1]
    assert [r.readings[0].problem for r in got] == [None, None, None, "bad_value", "missing", None]
    two = gate.Bands("a", "noul", 0.7, 0.4, on_missing="review", name="x")
    same = gate.apply_rule(df, two, {"a": a}, "d").select("p", "d.*").collect()
    assert str(same) == str(df.select("p", two.evaluate({"a": a}).alias("d")).select("p", "d.*").collect())
    bad = df.select(gate.Bands("a", "noul", 0.1, 0.4).evaluate({"a": a}).outcome.alias("o")).distinct().collect()
    assert [r.o for r in bad] == [3]


def test_table_scorer_and_validation(spark):
    s = TableScorer({("x", "q"): {"type": "noul", "noul": 2.0}})
    df = spark.createDataFrame([(0, "x", "x")], "item_index long, label string, state string").withColumns({"unit": F.lit("line"), "value": F.col("state"), "parts": F.array().cast("array<struct<lines:string,size:int,state:string>>")})
    r = Engine(spark, EngineConfig(scorer=s)).run(Template("t", {"q": Noul("?")}, {"q": "yes"}), df)
    assert r.items.first().q is None and r.summary["flagged"] == 0


def test_stream_collector(spark, tmp_path):
    rows = [(i, n, 1 + i % 3, n * 10, "failed" if (i, n) == (4, 2) else "complete", 0.1 * n) for i in range(9) for n in range(1, 2 + i % 3) if (i, n) != (8, 3)]
    df = spark.createDataFrame(rows, "item long, n int, of int, size int, status string, noul double")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = collector.collect_parts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.item: (r.parts, r.status, r.noul) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == set(range(8)) and got[4] == (2, "failed", None)
    assert got[5][2] == pytest.approx((10 * 0.1 + 20 * 0.2 + 30 * 0.3) / 60)


def test_stream_helpers(spark):
    v = spark.createDataFrame([("r", 1, True, "a"), ("r", 2, False, "b"), ("s", 1, False, "c")], "request_id string, seq long, flagged boolean, text string")
    assert {tuple(r) for r in collector.marks(v).collect()} == {("r", True, "a; b"), ("s", False, "c")}
    j = spark.createDataFrame([("x", i, i % 2 == 0) for i in range(250)], "session string, at long, flagged boolean")
    assert collector.session_log(j).count() == 200 and collector.totals(j).first().asDict() == {"session": "x", "checked": 250, "flagged": 125}


class Counting(HashScorer):
    """Writes a line for each question asked."""

    def __init__(self, log, model="hash-1"):
        self.log, self.model = str(log), model

    def ask(self, state, questions):
        with open(self.log, "a") as f:
            f.write("".join(f"{state} {k}\n" for k in sorted(questions)))
        return super().ask(state, questions)


def asked(log):
    out = log.read_text().split("\n")[:-1] if log.exists() else []
    log.unlink(missing_ok=True)
    return sorted(out)


def test_answers_are_cached(spark, tmp_path):
    """A second run asks nothing, another question is asked alone, and a new version asks what was cached once more."""
    log, cached = tmp_path / "log", str(tmp_path / "cache")
    one, two = Template("t", {"q": Noul("?")}, {"q": "yes"}), Template("t", {"q": Noul("?"), "r": Choice("?", (("a", None), ("b", None)))}, {"q": "yes"})
    data = tmp_path / "d.txt"
    data.write_text("x\ny\nx\n")
    state = lambda s: json.dumps(s)
    engine = lambda s: Engine(spark, EngineConfig(scorer=s, cache_dir=cached))
    first = engine(Counting(log)).run(one, [str(data)])
    assert first.summary["cached"] == 0 and len(asked(log)) == 3
    again = engine(Counting(log)).run(one, [str(data)])
    assert asked(log) == [] and again.summary["cached"] == 3
    assert sorted(r.q.noul for r in again.items.collect()) == sorted(r.q.noul for r in first.items.collect())
    more = engine(Counting(log)).run(two, [str(data)])
    assert {a.rsplit(" ", 1)[1] for a in asked(log)} == {"r"} and more.summary["cached"] == 3
    assert engine(Counting(log)).dry_run(two, [str(data)])["to_ask"] == 0
    # One new item shows a newer version: the cached answers of the others are asked again, once.
    data.write_text("x\ny\nz\n")
    s = Counting(log)
    renamed = Reporting(s)
    got = engine(renamed).run(one, [str(data)])
    assert sorted(set(asked(log))) == sorted(f"{state(v)} q" for v in "xyz") and got.summary["cached"] == 0
    assert engine(renamed).run(one, [str(data)]).summary["cached"] == 3 and asked(log) == []


class Reporting(Scorer):
    """The same model by name, which reports a version of its own."""

    def __init__(self, inner):
        self.inner, self.model, self.version = inner, inner.model, "hash-1.1"

    def ask(self, state, questions):
        return self.inner.ask(state, questions)


def test_invalid_cached_answers_are_asked_again(spark, tmp_path):
    log, cached = tmp_path / "log", str(tmp_path / "cache")
    t = Template("t", {"q": Noul("?")}, {"q": "yes"})
    data = tmp_path / "d.txt"
    data.write_text("x\n")
    e = Engine(spark, EngineConfig(scorer=Counting(log), cache_dir=cached, runs_dir=str(tmp_path / "runs")))
    e.run(t, [str(data)])
    asked(log)
    bad = cache.entries(spark, cached).withColumn("answer", F.col("answer").withField("noul", F.lit(7.0))).withColumn("time_ns", F.col("time_ns") + 1)
    cache.append(bad, cached)
    r = e.run(t, [str(data)])
    assert len(asked(log)) == 1 and r.summary["cached"] == 0
    e.resume(r.run.id, t)
    assert asked(log) == []


def test_no_function_is_defined_twice():
    import ast
    import pathlib

    for path in pathlib.Path(__file__).parent.parent.joinpath("verdimill").rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path


def test_hashes_are_computed_once(spark, sf):
    from verdimill.plans.queries import QUERIES

    for name, n in (("gate_compose", 9), ("choice_argmax", 3), ("verdicts_all", 9)):
        assert QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("md5(") == n
    plan = QUERIES["combine_choice"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2
