"""Provider B end to end: files with copies, repeated pieces, sub-agents and forks, to tables, commands and their truth."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import verify as V
from ledgerline.plans import commands as cmd
from ledgerline.plans import counter_tables as B
from ledgerline.plans import tables


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def meta(id, second=0, **more):
    return {"type": "session_meta", "timestamp": at(second), "payload": {"id": id, "cwd": "/work/app", "timestamp": at(second), **more}}


def child_of(parent):
    return {"source": {"subagent": {"thread_spawn": {"parent_thread_id": parent}}}}


def event(kind, second, **payload):
    return {"type": "event_msg", "timestamp": at(second), "payload": {"type": kind, **payload}}


def item(kind, second, **payload):
    return {"type": "response_item", "timestamp": at(second), "payload": {"type": kind, **payload}}


def context(second, turn, model="gpt-5"):
    return {"type": "turn_context", "timestamp": at(second), "payload": {"turn_id": turn, "model": model}}


def total(n, second):
    return event("token_count", second, info={"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": n, "reasoning_output_tokens": n // 10, "total_tokens": 2 * n}})


ROOT = [
    meta("r"), context(1, "t1"), event("user_message", 1, message="$big-job now"), item("message", 1, role="user", content=[{"text": "$big-job now"}]), total(100, 2), total(100, 3),
    item("function_call", 4, name="Agent", call_id="c1", arguments="{}"), item("function_call_output", 9, call_id="c1", output=json.dumps({"agent_id": "k"})), item("message", 9, role="assistant", content=[{"text": "done"}]), total(160, 10), event("task_complete", 11),
    context(20, "t2"), event("user_message", 20, message="and more"), total(200, 21),
]
FILES = {
    "r1": ROOT,
    # the chain goes on in a second file that repeats the end of the first
    "r2": [meta("r", 30), *ROOT[11:], context(40, "t3"), event("user_message", 40, message="last"), total(260, 41), event("turn_aborted", 42)],
    # a sub-agent that copied its root's first turn
    "k1": [meta("k", 5, **child_of("r")), *ROOT[1:5], context(6, "k1"), event("user_message", 6, message="do your part"), total(130, 7), event("task_complete", 8)],
    # a fork: copied events within seconds of its creation, before any prompt of its own
    "f1": [meta("f", 100, forked_from_id="r"), total(50, 101), total(70, 200)],
    "lost": [meta("x", 3, **child_of("gone")), event("user_message", 4, message="alone"), total(10, 5)],
    "none": [event("user_message", 4, message="no metadata"), total(10, 5)],
}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("rollouts")
    for name, rows in FILES.items():
        (root / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + ("{bad\n" if name == "r1" else ""))
    return str(root)


@pytest.fixture(scope="module")
def built(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables.write(B.build(spark, logs), path, "b")
    return tables.load(spark, path, "b")


def test_requests(built):
    got = {r["id"]: (r["session_id"], r["turn_id"], r["input_tokens"] + r["cache_read"], r["is_sidechain"]) for r in built.requests.collect()}
    assert got == {
        "b:r:r1.jsonl:token_count:t1:0": ("b:r", "t1", 100, False),
        "b:r:r1.jsonl:token_count:t1:1": ("b:r", "t1", 60, False),
        "b:r:r1.jsonl:token_count:t2:2": ("b:r", "t2", 40, False),
        "b:r:r2.jsonl:token_count:t3:0": ("b:r", "t3", 60, False),
        "b:k:token_count:k1:0": ("b:r", "k:k1", 30, True),  # from the total it copied
        "b:f:token_count:session:0": ("b:f", "session", 20, False),
        "b:x:token_count:generated-1:0": ("b:x", "generated-1", 10, False),
    }
    assert all(r["model"] == ("gpt-5" if r["session_id"] == "b:r" else None) for r in built.requests.collect())


def test_turns_sessions_and_steps(built):
    turns = {(r["session_id"], r["turn_id"]): (r["prompt"], r["is_sidechain"], r["interrupted"], r["agent_id"]) for r in built.turns.collect()}
    assert turns == {
        ("b:r", "t1"): ("$big-job now", False, False, None), ("b:r", "t2"): ("and more", False, True, None), ("b:r", "t3"): ("last", False, True, None), ("b:r", "k:k1"): ("do your part", True, False, "k"),
        ("b:x", "generated-1"): ("alone", False, False, None),
    }
    assert {(r["session_id"], r["project"], r["title"]) for r in built.sessions.collect()} == {("b:r", "/work/app", "$big-job now"), ("b:f", "/work/app", "f"), ("b:x", "/work/app", "alone")}
    assert built.steps.where("kind = 'prompt' and turn_id = 't1'").count() == 1  # the item that mirrors it is none
    assert [(r["turn_id"], r["skill"]) for r in built.skills.collect()] == [("t1", "big-job")]
    assert built.diagnostics.where("rejection = 'malformed'").count() == 1


def test_commands_answer(built):
    assert cmd.summary(built).first()["cost_usd"] > 0
    assert {r["project"]: r["sessions"] for r in cmd.projects(built).collect()}["/work/app"] >= 1
    assert [r["skill"] for r in cmd.skills(built).collect()] == ["big-job"]
    assert [(r["session_id"], r["hits"]) for r in cmd.search(built, "more").collect()] == [("b:r", 1)]
    assert cmd.top_sessions(built).first()["session_id"] == "b:r"


def test_truth_agrees_and_sees_faults(built):
    found = cmd.verify(built)[1]
    assert found.where("severity = 'error'").collect() == []
    cost = V.counter_session_truth(built.lines).where("session_id = 'b:r'").first()
    own = built.requests.where("session_id = 'b:r'").agg(F.sum("cost_usd").alias("c"), F.count("*").alias("n")).first()
    assert cost["requests"] == own["n"] and cost["cost_usd"] == pytest.approx(own["c"]) and own["c"] > 0
    # planted: a request lost, one billed twice, tokens and prices changed, a session lost
    faults = {
        "requests-mismatch": built.requests.where("id not like '%t3%'"),
        "input_tokens-mismatch": built.requests.withColumn("input_tokens", F.col("input_tokens") + F.when(F.col("turn_id") == "t2", 5).otherwise(0)),
        "cost-mismatch": built.requests.withColumn("cost_usd", F.col("cost_usd") + 1),
        "session-missing": built.requests.where("session_id <> 'b:r'"),
    }
    for kind, requests in faults.items():
        t = tables.Tables(**{**built.__dict__, "requests": requests})
        assert kind in {r["kind"] for r in cmd.verify(t)[1].collect()}


def test_long_context_rates_are_a_sessions(spark):
    usage = "struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint>"
    from ledgerline.functions.pricing import LONG_CONTEXT, LONG_THRESHOLD, price

    model = sorted(LONG_CONTEXT)[0]
    rows = [("s", "c", False, False, False, None, "p", 0, k, None, model, (n, 0, 10, 0, n + 10), None) for k, n in enumerate((5, LONG_THRESHOLD + 1))]
    events = spark.createDataFrame(rows, f"session_id string, chain string, is_child boolean, forked boolean, subagent boolean, created timestamp, piece string, piece_no long, line long, ts timestamp, model string, last_usage {usage}, total_usage {usage}")
    view = spark.createDataFrame([("s", model, None, n, 10, 0, 0, 0, 0) for n in (5, LONG_THRESHOLD + 1)], "session_id string, model string, speed string, input_tokens long, output_tokens long, reasoning_tokens long, cache_1h long, cache_5m long, cache_read long")
    assert V.counter_session_truth(events).first()["cost_usd"] == pytest.approx(price(view).agg(F.sum("cost_usd")).first()[0])


def test_line_issues(spark):
    rows = [("s", "/a/f1.jsonl", 0, None, None), ("s", "/a/f1.jsonl", 1, "malformed", None), ("s", "/a/f1.jsonl", 2, None, "missing"), ("s", "/a/f1.jsonl", 3, None, "duplicate"), (None, "/a/gone.jsonl", 0, None, None)]
    got = V.line_issues(spark.createDataFrame(rows, "session_id string, path string, line long, rejection string, skipped string")).collect()
    assert {(r["session_id"], r["kind"], r["line"], r["severity"]) for r in got} == {("gone", "source-rejected", None, "error"), ("s", "line-rejected", 1, "error"), ("s", "missing-usage", 2, "warning")}


def test_a_part_makes_only_what_it_needs(spark):
    """The verifier's lines need no steps, sides or requests, and prompts no requests."""
    lines = spark.createDataFrame([(f"/logs/{name}.jsonl", k, json.dumps(x)) for name, rows in FILES.items() for k, x in enumerate(rows)], "piece string, line long, value string")
    parts = B.Parts(spark, "", lines)
    assert V.counter_session_truth(parts.lines).count() > 0
    assert not {"kept", "steps", "sides", "requests"} & set(vars(parts))
    assert parts.steps.where("kind = 'prompt'").count() > 0
    assert not {"sides", "requests"} & set(vars(parts))
