"""Responses, attempts and manifests against plain versions."""

import hashlib
import json
import random
import uuid

from pyspark.sql import functions as F

from brindle.operators import ledger, manifest, responses

REQUEST = {"trial_id": "t", "request_hash": "h", "model": "m", "max_output_tokens": 10, "editable_files": ["a.py", "b.py"]}
GOOD = {"schema_version": 1, "model": "m", "request_hash": "h", "status": "ok", "edits": {"a.py": "x"}, "usage": {"input_tokens": 3, "output_tokens": 4, "cost_usd": 0.5}}


def plainly(body):
    """The rules one after another; None for no response."""
    none = (None, None, None)
    if body is None:
        return "missing_response", none, None
    try:
        r = json.loads(body)
    except ValueError:
        return "invalid_response", none, None
    if not isinstance(r, dict) or type(r.get("schema_version")) is not int or r["schema_version"] != 1 or r.get("model") != "m" or r.get("request_hash") != "h":
        return "invalid_response", none, None
    usage = {} if r.get("usage") is None else r["usage"]
    if not isinstance(usage, dict):
        return "invalid_response", none, None
    for name in ("input_tokens", "output_tokens", "cost_usd"):
        v = usage.get(name)
        if v is not None and (type(v) not in (int, float) or v < 0 or name != "cost_usd" and type(v) is not int):
            return "invalid_response", none, None
    told = tuple(None if usage.get(n) is None else usage[n] for n in ("input_tokens", "output_tokens", "cost_usd"))
    if r.get("status") in ("rate_limited", "provider_error", "invalid_response", "model_mismatch"):
        return r["status"], told, None
    if r.get("status") != "ok" or not isinstance(r.get("edits"), dict):
        return "invalid_response", told, None
    if told[1] is not None and told[1] > 10:
        return "budget_violation", told, None
    if not all(isinstance(v, str) and k in ("a.py", "b.py") for k, v in r["edits"].items()):
        return "invalid_candidate", told, None
    return "answered", told, r["edits"]


def test_responses_plainly(spark):
    rng = random.Random(4)
    values = {
        "schema_version": [1, 1, 1, 1, 1, 1, 1, 2, True, "1", None, 1.0], "model": ["m"] * 12 + ["n", 3, None], "request_hash": ["h"] * 12 + ["g", None],
        "status": ["ok"] * 6 + ["rate_limited", "provider_error", "invalid_response", "model_mismatch", "done", None, 1], "edits": [{"a.py": "x"}] * 5 + [{}, {"b.py": "", "a.py": "é"}, {"c.py": "x"}, {"a.py": 1}, [], None],
        "usage": [None, [], "x", {}] + [{}] * 8,
    }
    counters = [0, 3, 10, 11, -1, True, 2.5, "4", None]
    bodies = [None, "", "[]", "null", '"x"', json.dumps(GOOD)[:-1], json.dumps(GOOD)]
    for _ in range(600):
        r = {k: rng.choice(v) for k, v in values.items() if rng.random() < 0.97}
        if r.get("usage") == {}:
            r["usage"] = {n: rng.choice(counters[:3] if rng.random() < 0.8 else counters) for n in ("input_tokens", "output_tokens", "cost_usd") if rng.random() < 0.8}
        bodies.append(json.dumps(r))
    requests = spark.createDataFrame([(f"t{i}", *list(REQUEST.values())[1:]) for i in range(len(bodies))], "trial_id string, request_hash string, model string, max_output_tokens long, editable_files array<string>")
    given = spark.createDataFrame([(f"t{i}", b) for i, b in enumerate(bodies) if b is not None] + [("other", "{}"), (None, "{}")], "trial_id string, body string").repartition(3)
    got = {r.trial_id: r for r in responses.judged(requests, given).collect()}
    assert len(got) == len(bodies)
    for i, body in enumerate(bodies):
        r = got[f"t{i}"]
        outcome, told, edits = plainly(body)
        assert r.outcome == outcome, body
        assert (r.input_tokens, r.output_tokens, r.cost_usd) == told and (edits is None) == (r.edits is None), body
        assert edits is None or {e.path: e.content for e in r.edits} == edits
    assert len({r.outcome for r in got.values()}) == 8


def test_ledger_merges_plainly(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        rows.append({"request_hash": f"r{rng.randrange(60)}", "task": "t", "condition": "c", "attempt": rng.randrange(6), "id": f"{i:04}", "outcome": rng.choice(["passed", "test_failed", "provider_error", "rate_limited", None]),
                     "input_tokens": rng.choice([1, 2, None]) if rng.random() < 0.3 else 5, "cost_usd": 0.5, "output_tokens": None})
    root = f"{spark.conf.get('spark.checkpoint.dir')}/ledger-{uuid.uuid4().hex}"
    assert ledger.attempts(spark, root).count() == 0
    for part in (rows[:100], rows[100:101], rows[101:]):
        ledger.append(spark, root, part)
    kept = ledger.attempts(spark, root)
    assert kept.count() == 300
    got = {r.request_hash: r for r in ledger.merged(kept).collect()}
    for h in {r["request_hash"] for r in rows}:
        mine = sorted((r for r in rows if r["request_hash"] == h), key=lambda r: (r["attempt"], r["id"]))
        final = next((r for r in mine if r["outcome"] in ("passed", "test_failed")), mine[-1])
        known = all(r["input_tokens"] is not None for r in mine)
        r = got[h]
        assert (r.outcome, r.attempt, r.id, r.attempts) == (final["outcome"], final["attempt"], final["id"], len(mine))
        assert (r.total_input_tokens, r.total_cost_usd, r.total_output_tokens) == (sum(x["input_tokens"] for x in mine) if known else None, 0.5 * len(mine), None)
    assert ledger.totals(kept).first().asDict() == {"attempts": 300, "input_tokens": None, "output_tokens": None, "cost_usd": 150.0}
    assert ledger.totals(kept.limit(0)).first().asDict() == {"attempts": 0, "input_tokens": None, "output_tokens": None, "cost_usd": None}


def plain_tree(files):
    """Folders' hashes from nested dictionaries."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = {}
    for path, h in files.items():
        *folders, name = path.split("/")
        at = top
        for f in folders:
            at = at.setdefault(f + "/", {})
        at[name] = h
    out = {}

    def walk(path, node):
        shards = {}
        for name, child in node.items():
            h = walk(f"{path}/{name[:-1]}".strip("/"), child) if isinstance(child, dict) else child
            shards.setdefault(hashlib.md5(name.encode()).hexdigest()[:2], []).append((name, h))
        out[path] = sha("\n".join(f"{sha(chr(10).join(f'{h} {n}' for n, h in sorted(c)))} {s}" for s, c in sorted(shards.items())))
        return out[path]

    walk("", top)
    return out


def test_trees_plainly(spark, tmp_path):
    rng = random.Random(1)
    files = {"/".join(rng.choices("abc", k=rng.randint(1, 5))) + f"/f{i}": f"h{i}" for i in range(200)} | {"a/b": "a file of a folder's name", "top": "t"}
    now = {p: h for p, h in files.items() if rng.random() > 0.03} | {"a/new": "n", "z/z/z": "n"}
    now |= {p: "other" for p in rng.sample(sorted(now), 5)}
    frames = [spark.createDataFrame(list(f.items()) + extra, "path string, hash string").repartition(3) for f, extra in ((files, [(None, "x"), ("top", "u")]), (now, []))]
    trees = [manifest.tree(f).cache() for f in frames]
    for tree, plain in zip(trees, (files, now), strict=True):
        assert {r.path: r.hash for r in tree.where("NOT file").collect()} == plain_tree(plain)
        assert {r.path: r.hash for r in tree.where("file").collect()} == plain
    want = {p: "added" if p not in files else "removed" if p not in now else "changed" for p in {*files, *now} if files.get(p) != now.get(p)}
    assert {r.path: r.change for r in manifest.differences(*trees).collect()} == want
    assert manifest.differences(trees[0], trees[0]).count() == 0
    none = manifest.tree(frames[0].limit(0))
    assert none.count() == 0 and manifest.differences(none, trees[1]).count() == len(now)

    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a b.py").write_text("1")
    (tmp_path / "x" / "y" / "c.py").write_text("")
    got = {r.path: r.hash for r in manifest.files_of(spark, {"one": str(tmp_path / "x"), "two": str(tmp_path / "x" / "y")}).collect()}
    assert got == {"one/a b.py": hashlib.sha256(b"1").hexdigest(), "one/y/c.py": hashlib.sha256(b"").hexdigest(), "two/c.py": hashlib.sha256(b"").hexdigest()}
