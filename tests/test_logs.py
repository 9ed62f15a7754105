"""Reading and decoding of session logs, and what is assembled from them."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import conversation as C
from ledgerline.operators import counters as K
from ledgerline.sources import logs as L


def user(uuid, parent, content, **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "sessionId": "s", "timestamp": f"2024-01-01T00:00:{int(uuid[1:]):02d}Z", "message": {"role": "user", "content": content}, **more}


def assistant(uuid, parent, content, stop, message_id, tokens=(1, 2), **more):
    message = {"id": message_id, "role": "assistant", "model": "claude-opus-4-6", "stop_reason": stop, "content": content, "usage": {"input_tokens": tokens[0], "output_tokens": tokens[1], "cache_creation": {"ephemeral_1h_input_tokens": 7}}}
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "sessionId": "s", "timestamp": f"2024-01-01T00:00:{int(uuid[1:]):02d}.500Z", "requestId": f"r-{message_id}", "message": message, **more}


LINES = [
    user("u1", None, "hello"),
    assistant("u2", "u1", [{"type": "thinking", "thinking": ""}], None, "m1"),
    assistant("u3", "u2", [{"type": "text", "text": "let me see"}, {"type": "tool_use", "id": "t1", "name": "Agent", "input": {"b": 1}}], "tool_use", "m1", (1, 9)),
    user("u4", "u3", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "done"}, {"type": "text", "text": "agentId: abc1"}]}]),
    {"type": "attachment", "uuid": "u5", "parentUuid": "u4", "sessionId": "s"},
    assistant("u6", "u5", "fine", "end_turn", "m2"),
    user("u7", "u6", "<command-message>fix</command-message><command-args>it now</command-args>"),
    user("u8", "u7", "base directory", isMeta=True),
    user("u9", "u6", "[Request interrupted by user]"),
    user("u10", "u6", "<system-reminder>be good</system-reminder>"),
    user("u11", "u6", [{"type": "text", "text": "[Image source: /a/b.png]"}]),
    user("u12", "u6", []),
    {"type": "novelty", "uuid": "u13"},
    {"type": "user", "uuid": "u14", "sessionId": "s", "timestamp": "soon", "message": {"content": "x"}},
    {"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "x"}},
]


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "project").mkdir()
    text = "\n".join(json.dumps(x, separators=(",", ":")) for x in LINES)
    (root / "project" / "s.jsonl").write_text(text + "\n{\"type\":\"us", encoding="utf-8")
    lines = L.read_lines(spark, str(root))
    return L.decode_entries(lines).withColumn("place", F.col("line")).cache(), lines, text


def test_places(entries):
    _, lines, text = entries
    rows = sorted((r["line"], r["offset"], r["value"]) for r in lines.collect())
    raw = (text + "\n{\"type\":\"us").encode()
    assert [r[0] for r in rows] == list(range(len(LINES) + 1))
    assert all(raw[o : o + len(v.encode())].decode() == v for _, o, v in rows)
    assert L.complete_lines(lines).count() == len(LINES)


def test_outcomes(entries):
    got = {r["line"]: r["rejection"] for r in entries[0].collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "filtered", 5: None, 6: None, 7: None, 8: None, 9: "system-meta", 10: None, 11: "empty-user", 12: "unknown-type:novelty", 13: "bad-timestamp", 14: "missing:uuid", 15: "malformed"}


def test_fields(entries):
    rows = {r["line"]: r for r in entries[0].collect()}
    assert rows[6]["text"] == "/fix it now"
    assert rows[3]["results"][0]["content"] == "done\nagentId: abc1"
    assert rows[2]["tools"][0]["input"] == '{"b":1}'
    assert rows[2]["cache_1h_sub"] == 7 and rows[2]["output_tokens"] == 9
    assert rows[10]["image_meta"] and rows[10]["image_paths"] == ["/a/b.png"]
    assert rows[1]["ts"].replace(tzinfo=None) == datetime(2024, 1, 1, 0, 0, 2, 500_000)


def assembled(entries):
    good = entries.where("outcome = 'entry' and not image_meta").drop("path", "size", "modified", "line", "offset", "outcome", "rejection")
    skipped = entries.sparkSession.createDataFrame([("s", "u5", "u4")], "session_id string, uuid string, parent_uuid string")
    return C.turn_ids(C.merge_messages(good), C.parent_links(entries).unionByName(skipped))


def test_assembly(entries):
    steps = {r["uuid"]: r for r in assembled(entries[0]).collect()}
    assert {k: r["kind"] for k, r in steps.items()} == {"u1": "prompt", "u2": "thought", "u4": "toolResult", "u6": "reply", "u7": "prompt", "u8": "prompt", "u9": "interruption"}
    assert {k: r["turn_id"] for k, r in steps.items()} == {"u1": "u1", "u2": "u1", "u4": "u1", "u6": "u1", "u7": "u7", "u8": "u7", "u9": "u1"}
    assert steps["u2"]["output_tokens"] == 2 and steps["u2"]["stop_reason"] == "tool_use" and steps["u2"]["text"] == "let me see"


def test_links_and_images(entries):
    steps = assembled(entries[0])
    called = C.call_results(steps)
    assert [(r["agent_id"], r["call_turn"]) for r in C.agent_links(called).collect()] == [("abc1", "u1")]
    all_entries = entries[0].where("outcome = 'entry'")
    dropped = entries[0].sparkSession.createDataFrame([("s", "u3", "u2"), ("s", "u5", "u4"), ("s", "u11", "u6")], "session_id string, uuid string, parent_uuid string")
    nearest = C.nearest_prompts(steps, dropped)
    assert [(r["prompt"], r["paths"]) for r in C.attach_images(all_entries, nearest).collect()] == [("u1", ["/a/b.png"])]


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("s", "a", "b", None, True), ("s", "b", "a", None, True), ("s", "c", "d", None, True), ("s", "d", None, "d", True)], "session_id string, uuid string, parent_uuid string, value string, marked boolean")
    assert {r["uuid"]: r["found"] for r in C.closest(nodes, rounds=5).collect()} == {"a": "a", "b": "b", "c": "d", "d": "d"}


def test_roles(spark):
    paths = spark.createDataFrame([(p,) for p in ("file:/r/proj/s1.jsonl", "file:/r/proj/s1/subagents/agent-x.jsonl", "file:/r/proj/s1/subagents/workflows/w1/agent-y.jsonl", "file:/r/proj/s1/subagents/workflows/w1/plan.jsonl")], "path string")
    got = [(r["role"], r["project"], r["session"], r["agent"], r["run"]) for r in L.file_roles(paths).collect()]
    assert got == [("main", "proj", "s1", None, None), ("agent", "proj", "s1", "x", None), ("workflow", "proj", "s1", "y", "w1"), ("other", "proj", "s1", None, "w1")]


def rollout(*rows):
    return [json.dumps(r) for r in rows]


def event(kind, **payload):
    return {"type": "event_msg", "timestamp": payload.pop("at", "2024-01-01T00:01:00Z"), "payload": {"type": kind, **payload}}


def usage(n):
    return {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": n, "reasoning_output_tokens": 0, "total_tokens": 2 * n}


def test_rollouts(spark):
    rows = rollout(
        {"type": "session_meta", "payload": {"id": "x", "cwd": "/w", "forked_from_id": "p"}}, event("user_message", message="do it"), event("token_count", info={"total_token_usage": usage(10)}), event("token_count", info={"total_token_usage": usage(10)}),
        event("token_count", info={"last_token_usage": usage(4)}), event("task_complete"), event("user_message", message="more"), event("token_count", info={"total_token_usage": usage(20)}), event("token_count", info=None),
    )
    lines = spark.createDataFrame([(1, k, v) for k, v in enumerate(rows)], "piece long, line long, value string")
    events = L.decode_rollouts(lines)
    sessions = spark.createDataFrame([(1, "b:x", "gpt-5", datetime(2024, 1, 1), True, False)], "piece long, session_id string, model string, created timestamp, forked boolean, subagent boolean")
    got = sorted((r["id"], r["input_tokens"], r["cache_read"], r["model"]) for r in K.requests(events, sessions).collect())
    assert got == [("b:x:token_count:generated-1:0", 5, 5, "gpt-5"), ("b:x:token_count:generated-1:1", 2, 2, "gpt-5"), ("b:x:token_count:generated-2:2", 3, 3, "gpt-5")]


def piece_lines(spark, pieces):
    """Lines of pieces as (kind, text or usage) pairs."""
    rows = []
    for no, items in enumerate(pieces):
        for k, (kind, x) in enumerate(items):
            total = {"input_tokens": x, "cached_input_tokens": 0, "output_tokens": x, "reasoning_output_tokens": 0, "total_tokens": 2 * x} if kind == "token_count" else None
            rows.append(("s", no, no, k, "event_msg", kind, None, x if kind == "user_message" else None, None, None, total))
    struct = "struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint>"
    return spark.createDataFrame(rows, f"session_id string, piece_no long, piece long, line long, type string, payload_type string, role string, text string, turn_id string, last_usage {struct}, total_usage {struct}")


def test_repeated_pieces(spark):
    pieces = [[("user_message", "a"), ("token_count", 5), ("user_message", "b"), ("token_count", 9)], [("user_message", "b"), ("token_count", 9), ("user_message", "c"), ("token_count", 12)], [("user_message", "c"), ("user_message", "z")]]
    kept = K.trim_repeated_pieces(piece_lines(spark, pieces), ["type", "payload_type", "text"])
    assert sorted((r["piece_no"], r["line"]) for r in kept.collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 0), (2, 1)]


def overlap(known, own):
    return max((n for n in range(1, min(len(known), len(own)) + 1) if known[-n:] == own[:n]), default=0)


def spans_by_hand(pieces):
    """(session, piece, n) by going through each session's pieces one after another."""
    out = []
    for session in sorted({p[0] for p in pieces}):
        carry, turns = {m: [] for m in range(3)}, set()
        for _, no, rows in sorted(p for p in pieces if p[0] == session):
            first = next((i for i, r in enumerate(rows) if not r[1]), None)
            n = 0
            if first is not None and all(r[0] in turns for r in rows[:first] if r[0] is not None):
                rest = rows[first:]
                for m in range(3):
                    n = overlap(carry[m], [r[3 + m] for r in rest])
                    if n and any(r[2] for r in rest[:n]):
                        break
                    n = 0
            n = n if n < len(rows) else 0
            if n:
                out.append((session, no, n))
            kept = [r for i, r in enumerate(rows) if not (n and first <= i < first + n)]
            for m in range(3):
                carry[m] += [r[3 + m] for r in kept]
            turns |= {r[0] for r in kept if r[1] and r[0] is not None}
    return out


def test_spans_are_those_of_going_through_sessions(spark):
    """Random pieces over few keys, copies of whole earlier pieces, preludes with known and unknown turns."""
    r = random.Random(4)
    pieces = []
    for s in range(60):
        log = []
        for no in range(r.randint(1, 6)):
            back = r.randint(0, min(len(log), r.choice([2, 5, 40])))
            rows = [tuple(x) for x in log[len(log) - back :]]
            for _ in range(r.randint(0, 4)):
                prelude = r.random() < 0.3
                k = r.randint(0, 2)
                rows.append((r.choice([None, "t1", "t2"]) if prelude else None, prelude, not prelude and r.random() < 0.5, k, k if r.random() < 0.8 else 7, r.randint(0, 1)))
            if r.random() < 0.3:
                rows = [(r.choice(["t1", "t3"]), True, False, 9, 9, 9), *rows]
            if rows:
                pieces.append((f"s{s}", no, rows))
                log += rows
    flat = [(s, no, 10 * i, *row) for s, no, rows in pieces for i, row in enumerate(rows)]
    keys = spark.createDataFrame(flat, "session_id string, piece_no long, line long, turn_id string, prelude boolean, token boolean, k0 long, k1 long, k2 long")
    got = sorted((x["session_id"], x["piece_no"], x["n"]) for x in K.repeated_spans(keys, ["k0", "k1", "k2"]).collect())
    want = spans_by_hand(pieces)
    assert got == sorted(want) and len(want) > 30


def test_subagent_replay(spark):
    pieces = [[("user_message", "old"), ("token_count", 5), ("task_started", None), ("user_message", "new"), ("token_count", 7)], [("user_message", "old"), ("token_count", 5), ("agent_message", None)], [("user_message", "own")]]
    parents = spark.createDataFrame([(p, k, v) for p in (0, 1) for k, v in (("prompt", "old"), ("total", "5:0:5:0:10"))], "piece long, kind string, value string")
    kept = K.trim_subagent_replay(piece_lines(spark, pieces), parents)
    assert sorted((r["piece"], r["line"]) for r in kept.collect()) == [(0, 2), (0, 3), (0, 4), (1, 2), (2, 0)]


def test_attachments(entries):
    steps = assembled(entries[0]).withColumn("results", F.when(F.col("uuid") == "u4", F.expr("array(named_struct('tool_use_id', 't1', 'content', 'wrote /x/y.py', 'is_error', false))")).otherwise(F.col("results")))
    steps = steps.withColumn("tools", F.when(F.col("uuid") == "u2", F.expr("""array(named_struct('id', 't1', 'name', 'Edit', 'input', '{"file_path":"/x/y.py"}'))""")).otherwise(F.col("tools")))
    steps = steps.withColumn("text", F.when(F.col("uuid") == "u6", "see [it](https://a.org/b) and /x/y.py").when(F.col("uuid") == "u1", "fix /x/y.py").otherwise(F.col("text")))
    nearest = entries[0].sparkSession.createDataFrame([("s", "u1", ["/a/b.png"])], "session_id string, prompt string, paths array<string>")
    got = C.dedup_attachments(C.attachments(steps, nearest)).where("turn_id = 'u1'").collect()
    assert {(r["locator"], r["kind"], r["origin"]) for r in got} == {("/x/y.py", "file", "prompt-mention"), ("https://a.org/b", "url", "reply-mention"), ("/a/b.png", "image", "prompt-image-meta")}


def test_chain_order(spark):
    rows = spark.createDataFrame([("a", None, 3), ("b", "a", 2), ("c", "b", 1), ("d", "gone", 0)], "id string, parent string, created long")
    got = [(r["id"], r["root"], r["depth"]) for r in K.chain_order(rows).orderBy("root", "depth", "created", "id").collect()]
    assert got == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)]


def test_line_diagnostics(spark):
    lines = spark.createDataFrame([(1, 0, "no json"), (1, 1, '{"type":"novel"}'), *((1, 2 + k, json.dumps(event("token_count", info={"total_token_usage": usage(10)}))) for k in range(2))], "piece long, line long, value string")
    events = L.decode_rollouts(lines)
    found = K.line_diagnostics(events, K.resolve_usage(events.where("payload_type = 'token_count'")))
    assert {r["category"]: r["n"] for r in found.collect()} == {"malformed": 1, "unknown-type:novel": 1, "usage-duplicate": 1}
