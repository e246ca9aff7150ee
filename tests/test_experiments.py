import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluation, linking, presentation
from brindle.plans import experiments


@pytest.fixture(autouse=True)
def small_engine(tmp_path_factory, monkeypatch):
    """The package's own files are left out of the hash trees, which takes half of their time."""
    at = tmp_path_factory.mktemp("engine")
    (at / "one.py").write_text("")
    monkeypatch.setattr(experiments, "engine", lambda: str(at))


@pytest.fixture
def suite(tmp_path):
    (tmp_path / "one").mkdir()
    rows = [{"id": f"t{i}", "directory": "one", "task": "do", "query": "q", "editable": ["a.py"], "scope": "a.py:f", "evidence": "a.py", "lesson": "l"} for i in range(3)]
    (tmp_path / "suite.json").write_text(json.dumps({"schema_version": 1, "tasks": rows}))
    return tmp_path


def answer(request, edits=None, **other):
    return json.dumps({"schema_version": 1, "model": request["model"], "request_hash": request["request_hash"], "status": "ok", "edits": edits if edits is not None else {"a.py": "x"}, "usage": {"input_tokens": 5, "output_tokens": 1, "cost_usd": 0.5}} | other)


def made(task, condition):
    return experiments.stamped({"trial_id": f"{task.id}:{condition}", "model": "m", "prompt": f"{task.task} {condition}", "editable_files": ["a.py"], "max_output_tokens": 9})


def test_trials_resume(spark, suite):
    tasks = experiments.load_suite(str(suite / "suite.json"))
    asked = []

    def runner(request):
        asked.append(request["trial_id"])
        if len(asked) == 2:
            raise ValueError("no answer")
        return answer(request, {"a.py": "good" if request["trial_id"].endswith("graph") else "bad"})

    def go(request=made):
        return experiments.run(spark, tasks, str(suite / "out"), request, runner, lambda t, edits: "passed" if edits["a.py"] == "good" else "test_failed", ["lexical", "graph"])

    first = go()
    assert [t for t in asked if t.startswith("t1")] == ["t1:graph", "t1:lexical"]  # each task starts one later
    assert first["usage"] == {"input_tokens": None, "output_tokens": None, "cost_usd": None} and first["invocations"] == 6 and first["attempts"] == 6
    second = go()
    assert second["invocations"] == 1 and second["attempts"] == 7
    assert second["usage"]["input_tokens"] is None  # the failed attempt's bill is not known, whatever came later
    assert second["pairs"] == [{"baseline": "lexical", "contender": "graph", "matched": 3, "contender_only": 3, "baseline_only": 0}]
    assert go()["invocations"] == 0
    with pytest.raises(ValueError, match="request of"):
        go(lambda t, c: experiments.stamped(made(t, c) | {"prompt": "other"}))
    with pytest.raises(ValueError, match="conditions"):
        experiments.run(spark, tasks, str(suite / "out"), made, runner, None, ["graph"])
    (suite / "one" / "a.py").write_text("changed = 1\n")
    with pytest.raises(ValueError, match="added task-t0/a.py"):
        go()
    for bad in (["nope"], [], ["graph", "graph"], ["task_only"]):
        with pytest.raises(ValueError):
            experiments.selected_conditions(bad)
    assert experiments.selected_conditions(None) == ("lexical", "graph", "memory", "stale_memory")


def test_rate_limits_end_a_run_and_cut_short_runs_lose_nothing(spark, suite):
    tasks = experiments.load_suite(str(suite / "suite.json"))
    asked = []

    def limited(request):
        asked.append(request["trial_id"])
        return answer(request, status="rate_limited") if len(asked) == 2 else answer(request)

    go = lambda runner: experiments.run(spark, tasks, str(suite / "out"), made, runner, lambda t, e: "passed", ["lexical"])
    first = go(limited)
    assert len(asked) == 2 and first["attempts"] == 2 and first["usage"]["cost_usd"] == 1.0 and first["planned"] == 3

    def dies(request):
        if request["trial_id"] == "t2:lexical":
            raise KeyboardInterrupt
        return answer(request, usage=None)

    with pytest.raises(KeyboardInterrupt):
        go(dies)
    last = go(lambda request: answer(request))
    assert last["attempts"] == 4 and last["invocations"] == 1 and last["usage"]["cost_usd"] is None
    assert last["conditions"]["lexical"]["passed"] == 3
    (suite / "mixed").mkdir()
    (suite / "mixed" / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="empty"):
        experiments.run(spark, tasks, str(suite / "mixed"), made, limited, None, ["lexical"])


def test_calibrated(spark):
    results = spark.createDataFrame([("a", "solution", True), ("a", "broken", False)], "task string, kind string, passed boolean")
    assert experiments.calibrated(results) and not experiments.calibrated(results.withColumn("passed", F.lit(True)))


def test_web_links(spark):
    symbols = spark.createDataFrame([("a.ts:f", "a.ts"), ("b.ts:g", "b.ts"), ("b.ts:h", "b.ts")], "id string, path string")
    calls = spark.createDataFrame([("a.ts:f", "import", None, "./b.js", "g2"), ("a.ts:f", "import", None, "./b.js", "zz"), ("b.ts:g", "local", "h", None, None), ("b.ts:h", "unresolved", None, None, None)], "symbol string, kind string, name string, module string, export string")
    files = symbols.select("path").distinct()
    imports = spark.createDataFrame([("a.ts", "./b.js", "b.js")], "path string, module string, base string")
    modules = linking.resolve_modules(imports, files, [".ts", ".tsx"])
    exports = linking.without_conflicts(spark.createDataFrame([("b.ts", "g2", "g"), ("b.ts", "x", "g"), ("b.ts", "x", "h")], "path string, export string, local string"))
    assert {r.export for r in exports.collect()} == {"g2"}
    edges, missed = linking.link_web(calls, symbols, modules, exports, spark.createDataFrame([("q", "r")], "path string, name string"))
    assert {(r.src, r.dst) for r in edges.collect()} == {("a.ts:f", "b.ts:g"), ("b.ts:g", "b.ts:h")}
    assert {(r.symbol, r.unresolved) for r in missed.collect()} == {("a.ts:f", 1), ("b.ts:h", 1)}


def test_presentation(spark):
    rows = spark.createDataFrame([("g", i, i == 9) for i in range(10)], "g string, i int, first boolean")
    got = presentation.sampled(rows, "g", F.col("first"), "i").orderBy("nth").collect()
    assert [r.i for r in got] == [9, *range(7)] and {r.total for r in got} == {10}
    cut = spark.range(1).select(presentation.shortened(F.array(*[F.lit("x" * 99)] * 9)).alias("s")).first().s
    assert (len(cut["items"]), len(cut["items"][0]), cut.total) == (8, 80, 9)


@pytest.fixture
def coding(tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "prices.py").write_text("def net_price(x):\n    return round_cent(x) * 2\n\n\ndef round_cent(x):\n    return round(x, 2)\n")
    (tmp_path / "shop" / "long.py").write_text("def price_table():\n    pass\n" + "    # net_price\n" * 2000 + "    return 1\n")
    row = {"id": "t", "directory": "shop", "task": "round to cents", "query": "net_price", "editable": ["prices.py"], "scope": "prices.py:round_cent", "evidence": "prices.py", "lesson": "net prices are rounded first"}
    (tmp_path / "suite.json").write_text(json.dumps({"schema_version": 1, "tasks": [row]}))
    return tmp_path, experiments.load_suite(str(tmp_path / "suite.json"))[0]


def test_requests(spark, coding):
    at, task = coding
    seen, terms = {}, experiments.Terms("some-model", 1200, 200)
    bench = experiments.Workbench(spark, task, str(at / "scratch"))
    for condition in ("lexical", "hybrid_memory", "hybrid_stale_memory"):
        request, told = experiments.build_request(bench, condition, terms)
        assert request["request_hash"] == experiments.fingerprint({k: v for k, v in request.items() if k != "request_hash"})
        assert told["prompt_estimated_tokens"] == -(-len(request["prompt"].encode()) // 3) <= 1200
        seen[condition] = told | {"prompt": request["prompt"], "hashes": request["source_hashes"]}
    assert seen["lexical"]["included_files"] == ["prices.py"] and seen["lexical"]["omitted_files"] == ["long.py"]
    assert seen["hybrid_memory"]["included_lessons"] == [1] and "rounded first" in seen["hybrid_memory"]["prompt"]
    assert seen["hybrid_stale_memory"]["included_lessons"] == [] and "rounded first" not in seen["hybrid_stale_memory"]["prompt"]
    assert seen["lexical"]["lesson_origin"] is None and "prices.py:net_price" in seen["hybrid_memory"]["included_symbols"]
    assert seen["lexical"]["hashes"] == seen["hybrid_memory"]["hashes"] != seen["hybrid_stale_memory"]["hashes"]
    for bad in ((" ", 1200, 200), ("m", 100, 200), ("m", 1200, 1), ("m", True, 200)):
        with pytest.raises(ValueError):
            experiments.Terms(*bad)
    with pytest.raises(ValueError):
        experiments.build_request(bench, "nope", terms)


def test_default_conditions_run_with_built_requests(spark, coding):
    at, task = coding
    bench, terms = experiments.Workbench(spark, task, str(at / "scratch")), experiments.Terms("m", 1200, 200)
    out = experiments.run(spark, [task], str(at / "out"), lambda t, c: experiments.build_request(bench, c, terms)[0], lambda r: answer(r, {"prices.py": "x"}), lambda t, e: "passed")
    assert {c: v["passed"] for c, v in out["conditions"].items()} == dict.fromkeys(("lexical", "graph", "memory", "stale_memory"), 1)
    assert [(p["baseline"], p["contender"]) for p in out["pairs"]] == [("graph", "memory"), ("graph", "stale_memory"), ("lexical", "graph")]


def test_exported_and_prepared_requests(spark, coding):
    at, task = coding
    terms = experiments.Terms("m", 1200, 200)
    paths = experiments.export_requests(spark, [task], str(at / "out"), str(at / "scratch"), terms, ["lexical", "graph"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["t--lexical.json", "t--graph.json"]
    assert json.loads(open(paths[0]).read())["trial_id"] == "t:lexical"
    frozen = str(at / "frozen")
    manifest = experiments.prepare_trials(spark, [task], frozen, str(at / "scratch"), terms, 2, ["lexical", "hybrid"])
    assert manifest["order"] == ["t-lexical-r1", "t-hybrid-r1", "t-hybrid-r2", "t-lexical-r2"]
    with pytest.raises(ValueError):
        experiments.prepare_trials(spark, [task], frozen, str(at / "scratch"), terms, 2, ["lexical"])

    asked = []

    def runner(request):
        asked.append(request["trial_id"])
        assert request["output_schema"] == experiments.output_schema(["prices.py"]) and request["prompt"].endswith(experiments.OF_LOGS)
        path, tokens = ("other.py" if request["trial_id"] == "t:hybrid:r1" else "prices.py"), (201 if request["trial_id"] == "t:hybrid:r2" else 200)
        text = json.dumps({"edits": [{"path": path, "content": "x"}]})
        return "\n".join(map(json.dumps, [{"type": "item.completed", "item": {"type": "agent_message", "text": text}}, {"type": "turn.completed", "usage": {"input_tokens": 1, "output_tokens": tokens}}]))

    out = experiments.run_prepared(spark, [task], frozen, runner, lambda t, e: "passed")
    assert asked == ["t:lexical:r1", "t:hybrid:r1", "t:hybrid:r2", "t:lexical:r2"] and out["usage"]["cost_usd"] is None and out["usage"]["input_tokens"] == 4
    assert {(r["condition"], r["outcome"], r["n"]) for r in out["outcomes"]} == {("lexical", "passed", 2), ("hybrid", "invalid_candidate", 1), ("hybrid", "output_budget_violation", 1)}
    assert experiments.run_prepared(spark, [task], frozen, runner, lambda t, e: "passed")["invocations"] == 1  # what isn't scored is asked again
    (at / "shop" / "checks.py").write_text("# other acceptance\n")
    with pytest.raises(ValueError, match="added task-t/checks.py"):
        experiments.run_prepared(spark, [task], frozen, runner, None)


def test_replay(tmp_path):
    (tmp_path / "saved.json").write_text(json.dumps({"schema_version": 1, "responses": {"t:graph": {"status": "ok"}}}))
    runner = experiments.ReplayRunner(str(tmp_path / "saved.json"))
    assert json.loads(runner({"trial_id": "t:graph"})) == {"status": "ok"} and runner({"trial_id": "t:other"}) is None
    for bad in ("[]", '{"schema_version": 2, "responses": {}}', '{"schema_version": 1, "responses": []}'):
        (tmp_path / "saved.json").write_text(bad)
        with pytest.raises(ValueError):
            experiments.ReplayRunner(str(tmp_path / "saved.json"))


def test_set_recall(spark):
    expected = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")], "case string, id string")
    found = spark.createDataFrame([("a", "x", "graph"), ("a", "q", "graph"), ("a", "x", "lexical"), ("a", "y", "lexical"), ("b", "q", "lexical")], "case string, id string, method string")
    got = {r.case: (r.graph_recall, r.lexical_recall, r.missing) for r in evaluation.set_recall(expected, found, "graph", "lexical").collect()}
    assert got == {"a": (0.5, 1.0, 1), "b": (0.0, 0.0, 1)}
