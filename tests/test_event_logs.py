"""Event logs against a plain reading of their rules, one log after another."""

import json
import random

import pytest

from brindle.operators import event_logs

NAMES = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
GOOD = {"edits": [{"path": "a.py", "content": "pass\n"}]}


def message(candidate, kind="item.completed"):
    return {"type": kind, "item": {"type": "agent_message", "text": candidate if isinstance(candidate, str) else json.dumps(candidate)}}


def done(usage=None):
    return {"type": "turn.completed", "usage": usage}


def text_of(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events)


START = ({"type": "thread.started", "thread_id": "x"}, {"type": "turn.started"})
CASES = {
    "counts": (text_of(*START, message(GOOD), done({"input_tokens": 100, "cached_input_tokens": 0, "output_tokens": 7})), "ok", (100, 0, 7, None)),
    "no usage": (text_of(*START, message(GOOD), done()), "ok", None),
    "cached": (text_of(message(GOOD), done({"input_tokens": 1, "cached_input_tokens": 2})), "invalid_usage", None),
    "types": (text_of(message(GOOD), done({"input_tokens": True, "cached_input_tokens": 5.0, "output_tokens": "7", "reasoning_output_tokens": -1})), "ok", (None,) * 4),
    "huge": (text_of(message(GOOD), done({"input_tokens": 10**30, "output_tokens": 0})), "ok", (None, None, 0, None)),
    **{k: (text_of(*START, {"type": "item.started", "item": {"type": k}}, message(GOOD), done()), "tool_contamination", None) for k in ("mcp_tool_call", "command_execution", "web_search", "file_change")},
    "item null": (text_of({"type": "item.updated", "item": None}, message(GOOD), done()), "tool_contamination", None),
    "item missing": (text_of({"type": "item.updated"}, message(GOOD), done()), "tool_contamination", None),
    "reasoning": (text_of({"type": "item.completed", "item": {"type": "reasoning", "text": "hm"}}, message(GOOD), done()), "ok", None),
    "twice a path": (text_of(message({"edits": [*GOOD["edits"], {"path": "a.py", "content": "two"}]}), done()), "invalid_candidate", None),
    "extra key": (text_of(message({"edits": [{"path": "a", "content": "b", "mode": 1}]}), done()), "invalid_candidate", None),
    "beside edits": (text_of(message(GOOD | {"note": "x"}), done()), "invalid_candidate", None),
    "no strings": (text_of(message({"edits": [{"path": 1, "content": "b"}]}), done()), "invalid_candidate", None),
    "no list": (text_of(message({"edits": {"a.py": "b"}}), done()), "invalid_candidate", None),
    "no json": (text_of(message("sorry"), done()), "invalid_candidate", None),
    "no message": (text_of(*START, done()), "invalid_candidate", None),
    "no edits": (text_of(message({"edits": []}), done()), "ok", None),
    "last counts": (text_of(message("draft"), message(GOOD), message("later", "item.updated"), done()), "ok", None),
    "last is bad": (text_of(message(GOOD), message("draft"), done()), "invalid_candidate", None),
    "cut short": (text_of(*START, message(GOOD)), "provider_error", None),
    "two turns": (text_of(message(GOOD), done({"input_tokens": 1}), done({"input_tokens": 2})), "provider_error", None),
    "failed": (text_of(message(GOOD), done({"input_tokens": 3}), {"type": "turn.failed"}), "provider_error", (3, None, None, None)),
    "error": (text_of(message(GOOD), done(), {"type": "error"}), "provider_error", None),
    "truncated": (text_of(message(GOOD), done({"input_tokens": 3}), "truncated"), "invalid_trace", None),
    "unknown": (text_of(message(GOOD), done(), '{"type":"unknown.tool"}'), "invalid_trace", None),
    "no object": (text_of(message(GOOD), done(), "[1]"), "invalid_trace", None),
    "empty": ("", "invalid_trace", None),
    "blank": (" \n\t\r\n", "invalid_trace", None),
    "blanks between": ("\n\n".join([text_of(message(GOOD)), "  ", text_of(done({"output_tokens": 1}))]), "ok", (None, None, 1, None)),
}


def plainly(text):
    try:
        events = [json.loads(x) for x in text.splitlines() if x.strip()]
    except ValueError:
        return "invalid_trace", None, None
    if not events or not all(isinstance(e, dict) and isinstance(e.get("type"), str) and e["type"] in event_logs.EVENTS for e in events):
        return "invalid_trace", None, None
    ends, usage = [e for e in events if e["type"] == "turn.completed"], None
    if len(ends) == 1 and isinstance(ends[0].get("usage"), dict):
        usage = tuple(v if type(v := ends[0]["usage"].get(k)) is int and 0 <= v < 2**63 else None for k in NAMES)
        if usage[0] is not None and usage[1] is not None and usage[1] > usage[0]:
            return "invalid_usage", None, None
    items = [e.get("item") for e in events if e["type"].startswith("item.")]
    if not all(isinstance(i, dict) and i.get("type") in ("reasoning", "agent_message") for i in items):
        return "tool_contamination", usage, None
    if len(ends) != 1 or any(e["type"] in ("turn.failed", "error") for e in events):
        return "provider_error", usage, None
    said = [e["item"].get("text") for e in events if e["type"] == "item.completed" and e["item"]["type"] == "agent_message"]
    try:
        candidate = json.loads(said[-1])
        pairs = [(r["path"], r["content"]) for r in candidate["edits"]]
        good = isinstance(candidate, dict) and set(candidate) == {"edits"} and isinstance(candidate["edits"], list) and all(set(r) == {"path", "content"} for r in candidate["edits"])
    except (ValueError, TypeError, KeyError, IndexError):
        good = False
    if not good or not all(isinstance(x, str) for p in pairs for x in p) or len({p for p, _ in pairs}) < len(pairs):
        return "invalid_candidate", usage, None
    return "ok", usage, pairs


def read(spark, logs, parts=3):
    rows = event_logs.lines_of(spark.createDataFrame(list(logs.items()), "log string, text string")).repartition(parts)
    out = {}
    for r in event_logs.outcomes(rows).collect():
        out[r.log] = (r.status, tuple(r[n] for n in NAMES) if r.has_usage else None, None if r.edits is None else [tuple(e) for e in r.edits])
    return out


def test_outcomes(spark):
    got = read(spark, {k: v[0] for k, v in CASES.items()})
    for name, (text, status, usage) in CASES.items():
        assert got[name][:2] == (status, usage), name
        assert got[name] == plainly(text), name


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_of_random_logs(spark, seed):
    """Events of all kinds, in any order, damaged now and then; some logs of many lines."""
    rng = random.Random(seed)
    values = [0, 5, 7, -1, True, None, 2.5, "3", {}, []]
    some = lambda: rng.choice(values)

    def event():
        kind = rng.choice([*event_logs.EVENTS, "item.completed", "turn.completed"] * 4 + ["other", None, 3])
        e = {"type": kind}
        if rng.random() < 0.9 and str(kind).startswith("item"):
            edits = [{"path": rng.choice(["a", "b", 1] if rng.random() < 0.1 else ["a", "b"]), "content": "é\n" if rng.random() < 0.95 else some()} for _ in range(rng.randint(0, 2))]
            e["item"] = {"type": rng.choice(["agent_message"] * 9 + ["reasoning", "web_search"]), "text": json.dumps({"edits": edits}) if rng.random() < 0.9 else some()}
        if kind == "turn.completed" and rng.random() < 0.8:
            e["usage"] = {n: some() for n in NAMES if rng.random() < 0.7}
        return json.dumps(e, ensure_ascii=rng.random() < 0.5) if rng.random() < 0.99 else json.dumps(e)[:-2]

    logs = {str(i): "\n".join(event() for _ in range(rng.randint(0, 4))) for i in range(400)}
    for i in range(150):  # mostly good ones
        logs[f"g{i}"] = text_of(*START, message(GOOD), *([message({"edits": [{"path": "b", "content": str(i)}]})] * rng.randint(0, 2)), done({n: some() for n in NAMES}))
    logs["long"] = text_of(*[message("draft")] * 3000, message(GOOD), done())
    got = read(spark, logs)
    assert got == {k: plainly(v) for k, v in logs.items()}
    assert len({v[0] for v in got.values()}) == 6


def test_hard_cases(spark):
    rows = [(None, 1, text_of(done())), (None, 0, text_of(message(GOOD))), ("a", 0, None)]
    got = {r.log: r.status for r in event_logs.outcomes(spark.createDataFrame(rows, "log string, seq int, line string")).collect()}
    assert got == {None: "ok", "a": "invalid_trace"}
    assert event_logs.outcomes(spark.createDataFrame([], "log string, seq int, line string")).collect() == []
