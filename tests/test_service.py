"""Requests over small authored trees."""

import json
import subprocess

import pytest

from brindle.functions.python_units import class_declarations, exception_classes, unit
from brindle.operators.lessons import LessonTable
from brindle.plans.context import compile_context, impact, localize
from brindle.plans.investigate import investigate
from brindle.plans.service import EvidenceService, load_summary, summarize, write_json
from brindle.plans.snapshot import Snapshot

TREE = {
    "shop/__init__.py": "",
    "shop/prices.py": "RATE = 2\n\n\ndef net_price(line):\n    return round_cent(line.amount) * RATE\n\n\ndef round_cent(x):\n    return round(x, 2)\n",
    "shop/cart.py": "from .prices import net_price as price\nfrom . import prices\n\n\nclass CartError(ValueError):\n    pass\n\n\nclass Cart:\n    def total(self, lines):\n        if not lines:\n            raise CartError('empty')\n        return self.add(price(x) for x in lines)\n\n    def add(self, items):\n        return prices.round_cent(sum(items))\n",
    "tests/test_cart.py": "from shop.cart import Cart\n\n\ndef test_total():\n    assert Cart().total([]) is None\n\n\ndef shadowed(price):\n    return price(1)\n",
}


def make(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return root


@pytest.fixture
def tree(tmp_path):
    return make(tmp_path / "tree", TREE)


def edges(snap):
    return {(r.src.split(":")[1], r.dst.split(":")[1]) for r in snap.edges.collect()}


WANT = {("net_price", "round_cent"), ("Cart.total", "net_price"), ("Cart.total", "Cart.add"), ("Cart.add", "round_cent")}


def test_capture_and_link(spark, tree):
    make(tree, {".venv/hidden.py": "x = 1", "broken.py": "def (", "big.py": "#" * 1_000_001, "a.ts": "let x", "_own.py": "def f():\n    g()\n"})
    (tree / "link.py").symlink_to(tree / "broken.py")
    snap = Snapshot.of_tree(spark, str(tree))
    paths = {r.path for r in snap.sources.select("path").collect()}
    assert paths == {*TREE, "broken.py", "a.ts", "_own.py"}
    assert edges(snap) == WANT
    assert {w.split(":")[0] for w in snap.warnings} == {"Skipped symbolic link", "Skipped file larger than 1000000 bytes", "Cannot parse broken.py"}
    assert {r.path for r in snap.hashes.collect()} == {*TREE, "_own.py", "a.ts"}
    off = Snapshot.of_files(spark, snap.sources.select("path", "content"), web=False)
    assert [w for w in off.warnings if w.startswith("TypeScript/JavaScript parsing unavailable")] and "a.ts" not in {r.path for r in off.hashes.collect()}


def test_files_are_checked(spark):
    rows = [("ok.py", b"def f():\n    pass\n"), ("../up.py", b""), ("a/.b/c.py", b""), ("x.d.ts", b""), ("a\\b.py", b"")]
    snap = Snapshot.of_files(spark, spark.createDataFrame(rows, "path string, content binary"))
    assert [r.id for r in snap.symbols.collect()] == ["ok.py:f"]
    assert len(snap.warnings) == 4


def test_module_collision_last_path_wins(spark):
    rows = [("m.py", b"def f():\n    pass\n"), ("m/__init__.py", b"def f():\n    pass\n"), ("u.py", b"import m\ndef g():\n    m.f()\n")]
    snap = Snapshot.of_files(spark, spark.createDataFrame(rows, "path string, content binary"))
    assert [(r.src, r.dst) for r in snap.edges.collect()] == [("u.py:g", "m/__init__.py:f")]


def test_unit():
    u = unit("p/q.py", b"from ..a import b as c\nimport d.e\ndef f(x):\n    def h(): c()\n    x.y(); d.e.z(); c(); (lambda: c.q())()\n")
    assert u["aliases"] == {"c": "a.b", "d": "d"} and {c["candidate"] for c in u["calls"]} == {"d.e.z", "a.b"}
    assert unit("x.py", b"# coding: nope\n")["hash"] is None


def test_exception_declarations():
    raw = b"class B(A): pass\nclass A(ValueError): pass\nclass C(Exception): pass\nC = 1\n"
    assert set(exception_classes("m.py", raw)) == {"A", "B"}
    assert class_declarations("m.py", "def f():\n    raise B()", raw).count("Module exception declaration") == 2
    assert class_declarations("m.py", "def f(B):\n    raise B()", raw) == ""
    assert exception_classes("m.py", b"from x import *\nclass A(ValueError): pass\n") == {}


def slow_impact(pairs, seeds, depth):
    distance, reasons, queue = dict.fromkeys(sorted(seeds), 0), {s: ["requested seed"] for s in seeds}, sorted(seeds)
    for k in queue:
        if distance[k] < depth:
            near = [(a, f"calls {k}") for a in sorted(a for a, b in pairs if b == k)] + [(b, f"called by {k}") for b in sorted(b for a, b in pairs if a == k)]
            for other, why in near:
                if other not in distance:
                    distance[other], reasons[other] = distance[k] + 1, []
                    queue.append(other)
                if why not in reasons[other]:
                    reasons[other].append(why)
    return [{"id": k, "distance": distance[k], "reasons": reasons[k]} for k in sorted(distance, key=lambda k: (distance[k], k))]


def test_impact(spark, tree):
    snap = Snapshot.of_tree(spark, str(tree))
    pairs = {(r.src, r.dst) for r in snap.edges.collect()}
    for depth in (0, 1, 2, 5):
        assert impact(snap, ["round_cent"], depth).candidates() == slow_impact(pairs, ["shop/prices.py:round_cent"], depth)
    with pytest.raises(ValueError):
        impact(snap, ["nothing"], 1)
    with pytest.raises(ValueError):
        impact(snap, ["round_cent"], 6)


def test_packet(spark, tree):
    snap = Snapshot.of_tree(spark, str(tree))
    pool = impact(snap, ["Cart.total"], 1)
    packet = compile_context(snap, pool, 2000)
    assert packet["complete"] and packet["missing_seeds"] == []
    assert packet["estimated_tokens"] == -(-len(packet["text"].encode()) // 3)
    assert "Module exception declaration: shop/cart.py:5-6 | CartError" in packet["text"]
    small = compile_context(snap, pool, 128)
    assert not small["complete"] and small["estimated_tokens"] <= 128
    note = {"id": 7, "scope": "shop/cart.py:Cart.total", "lesson": "mind empty carts", "evidence": "shop/cart.py", "status": "confirmed", "stale": False}
    assert compile_context(snap, pool, 2000, [note])["included_lessons"] == [7]
    assert compile_context(snap, pool, 2000, [note | {"stale": True}])["included_lessons"] == []
    with pytest.raises(ValueError):
        compile_context(snap, pool, 2000, ranked=[{"id": "x"}])


def test_units_are_reused(spark, tree, tmp_path):
    at = (tmp_path / "units").as_uri()
    cold = Snapshot.of_tree(spark, str(tree), at)
    warm = Snapshot.of_tree(spark, str(tree), at)
    assert (cold.indexing["parsed_files"], warm.indexing["parsed_files"], warm.indexing["reused_files"]) == (4, 0, 4)
    make(tree, {"shop/prices.py": TREE["shop/prices.py"].replace("round_cent(line", "other(line")})
    edited, fresh = Snapshot.of_tree(spark, str(tree), at), Snapshot.of_tree(spark, str(tree))
    assert (edited.indexing["parsed_files"], edited.indexing["reused_files"]) == (1, 3)
    for name in ("symbols", "edges", "hashes"):
        a, b = getattr(edited, name), getattr(fresh, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert edges(warm) == WANT and edges(edited) == WANT - {("net_price", "round_cent")}


def test_lessons(spark, tree, tmp_path):
    snap = Snapshot.of_tree(spark, str(tree))
    table = LessonTable(spark, (tmp_path / "notes").as_uri())
    scope = "shop/cart.py:Cart.total"
    assert table.add(snap.symbols, snap.hashes, scope, "empty carts raise", "tests/test_cart.py") == 1
    assert table.add(snap.symbols, snap.hashes, scope, "opaque zebra advice", "shop/prices.py") == 2
    for bad in (("nope", "x", "shop/cart.py"), (scope, " ", "shop/cart.py"), (scope, "x", "../up.py"), (scope, "x", "missing.py")):
        with pytest.raises(ValueError):
            table.add(snap.symbols, snap.hashes, *bad)
    table.set_status(2, "confirmed", snap.hashes)
    with pytest.raises(ValueError):
        table.set_status(9, "confirmed", snap.hashes)
    service = EvidenceService(spark, str(tree), notes_at=table.root)
    assert [m["id"] for m in service.search_symbols("zebra")["matches"]] == [scope]
    assert [n["id"] for n in service.get_lessons([scope])["lessons"]] == [2]
    make(tree, {"shop/prices.py": TREE["shop/prices.py"] + "\n"})
    assert [r.stale for r in table.list(Snapshot.of_tree(spark, str(tree)).hashes).orderBy("id").collect()] == [False, True]
    with pytest.raises(ValueError):
        table.set_status(2, "confirmed", Snapshot.of_tree(spark, str(tree)).hashes)
    assert service.search_symbols("zebra")["matches"] == []
    assert service.get_lessons([scope])["excluded_lessons"][1] == {"id": 2, "status": "confirmed", "stale": True}


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(root), *args], check=True, capture_output=True)


def test_changes(spark, tree):
    git(tree, "init", "-q")
    git(tree, "add", "-A")
    git(tree, "commit", "-qm", "one")
    make(tree, {
        "shop/prices.py": TREE["shop/prices.py"].replace("round(x, 2)", "round(x, 3)"),
        "shop/cart.py": TREE["shop/cart.py"].replace("def add", "def join").replace("self.add", "self.join"),
        "new.py": "def untracked():\n    pass\n", "notes.txt": "x",
    })
    git(tree, "add", "notes.txt")
    (tree / "tests/test_cart.py").unlink()
    report = localize(spark, str(tree)).report
    assert {f["path"]: f["status"] for f in report["files"]} == {"shop/prices.py": "modified", "shop/cart.py": "modified", "tests/test_cart.py": "deleted", "notes.txt": "added"}
    assert "shop/cart.py:Cart.add" in report["removed_symbols"] and "tests/test_cart.py:test_total" in report["removed_symbols"]
    assert {"shop/prices.py:round_cent", "shop/prices.py:net_price", "shop/cart.py:Cart.join", "shop/cart.py:Cart.total"} <= set(report["current_seeds"])
    assert report["excluded_untracked"] == ["new.py"]
    assert {u["path"] for u in report["unresolved"]} == {"notes.txt", "tests/test_cart.py"}
    service = EvidenceService(spark, str(tree))
    packet = service.compile_context(ref="HEAD", max_tokens=3000)
    assert "=== CURRENT EVIDENCE ===" in packet["text"] and "=== HISTORICAL EVIDENCE at" in packet["text"]
    assert packet["estimated_tokens"] <= 3000
    run = service.investigate(ref="HEAD", max_depth=1, max_seconds=120)
    assert (run["status"], run["stop_reason"]) == ("partial", "unresolved_changes")
    with pytest.raises(ValueError):
        localize(spark, str(tree), "--output=x")


@pytest.mark.parametrize("request_, status", [
    ({"task": "zzzzunknownsymbol"}, ("needs_input", "no_matches")),
    ({"symbols": ["round_cent"], "max_depth": 0}, ("partial", "depth_limit")),
    ({"symbols": ["round_cent"], "max_steps": 2}, ("partial", "step_limit")),
    ({"symbols": ["Cart.total"], "max_tokens": 128}, ("partial", "token_budget")),
    ({"task": "round_cent"}, ("ready", "graph_covered")),
    ({"task": "cart total", "retrieval": "legacy"}, ("ready", "graph_covered")),
])
def test_investigation(spark, tree, request_, status):
    run = investigate(spark, str(tree), max_seconds=120, **request_)
    assert (run["status"], run["stop_reason"]) == status
    assert [e["sequence"] for e in run["trace"]] == list(range(1, len(run["trace"]) + 1))


def test_investigation_clock_and_bounds(spark, tree, tmp_path):
    ticks = iter([0.0, 0.0, *[5.0] * 50])
    run = investigate(spark, str(tree), symbols=["round_cent"], max_seconds=1, clock=lambda: next(ticks))
    assert run["stop_reason"] == "time_limit"
    write_json(str(tmp_path / "run.json"), run)
    told = load_summary(str(tmp_path / "run.json"))
    assert told["status"] == "partial" and told["evidence"] == {} and told["estimated_tokens"] == 0 and told["trace"][-1]["reason"] == "time_limit"
    make(tree, {"broken.py": "def ("})
    assert investigate(spark, str(tree), symbols=["round_cent"], max_seconds=120)["stop_reason"] == "index_warnings"
    for bad in ({}, {"task": "a", "ref": "b"}, {"task": " "}, {"symbols": []}, {"task": "a", "max_tokens": 1}, {"task": "a", "max_seconds": float("nan")}):
        with pytest.raises(ValueError):
            investigate(spark, str(tree), **bad)


def test_summaries(spark, tree, tmp_path):
    run = investigate(spark, str(tree), task="cart total", max_seconds=120)
    told = summarize(json.loads(json.dumps(run)))
    assert [r["id"] for r in told["evidence"]["current"]] == [r["id"] for r in run["context"]["included"]] and set(told["evidence"]["current"][0]) == {"id", "path", "start", "end", "reasons"}
    assert told["verification"] == run["verification"] and told["retrieval"] == run["retrieval"] and told["warnings"] == list(dict.fromkeys(run["context"]["warnings"]))
    assert len(told["trace"]) == len(run["trace"]) and not any("candidates" in step for step in told["trace"])
    assert run["context"]["text"] not in json.dumps(told)
    broken = [[], {}, run | {"schema_version": 2}, run | {"status": "done"}, run | {"trace": None}, {k: v for k, v in run.items() if k != "limits"}, run | {"context": {"text": "x"}}]
    for bad in broken:
        with pytest.raises(ValueError):
            summarize(bad)
    for data in (b"{", b"\xff\xfe", b'{"a": "' + b"x" * 10_000_000 + b'"}'):
        (tmp_path / "bad.json").write_bytes(data)
        with pytest.raises(ValueError):
            load_summary(str(tmp_path / "bad.json"))


def test_command_line(spark, tree, tmp_path, capsys):
    from brindle.__main__ import main

    assert main([str(tree), "search_symbols", "--query", "cart total", "--limit", "2"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found["matches"]) == 2 and found["retrieval"] == "hybrid"
    assert main([str(tree), "analyze_impact", "--symbols", "round_cent", "--depth", "1", "--detail", "full"], spark) == 0
    assert json.loads(capsys.readouterr().out)["candidates"][0]["distance"] == 0
    write_json(str(tmp_path / "run.json"), investigate(spark, str(tree), symbols=["round_cent"], max_seconds=120))
    assert main(["summary", str(tmp_path / "run.json")], spark) == 0 and json.loads(capsys.readouterr().out)["status"] == "ready"
    assert main([str(tree), "search_symbols", "--query", " "], spark) == 2 and "query" in capsys.readouterr().err
    assert main([str(tmp_path / "nothing"), "localize_changes"], spark) == 2
    assert main(["summary", str(tmp_path / "nothing")], spark) == 2


def test_names_are_folded(spark):
    rows = [("a.py", "def straße():\n    pass\n\n\ndef Name():\n    pass\n".encode())]
    snap = Snapshot.of_files(spark, spark.createDataFrame(rows, "path string, content binary"))
    for query, name in (("strasse", "straße"), ("STRASSE", "straße"), ("Straße", "straße"), ("NAME", "Name"), ("a.py:STRASSE", "straße")):
        assert [r.id for r in snap.lexical(query).where("exact").collect()] == [f"a.py:{name}"], query
    assert "folded" not in snap.describe()["symbols"][0]


def test_verbs_have_short_views(spark, tree):
    service = EvidenceService(spark, str(tree))
    short, full = service.tool("search_symbols", query="net price"), service.tool("search_symbols", detail="full", query="net price")
    assert short["matches"] == full["matches"] and full["retrieval"] == "hybrid" and "presentation" not in full
    assert short["presentation"]["detail"] == "compact" and {"full_detail", "scope"} <= short["presentation"].keys()
    for bad in ({"verb": "nope"}, {"verb": "search_symbols", "detail": "other", "query": "x"}, {"verb": "search_symbols", "query": "x", "limit": True}, {"verb": "analyze_impact"}, {"verb": "compile_context", "symbols": ["a"], "max_tokens": 1}):
        with pytest.raises(ValueError):
            service.tool(**bad)
