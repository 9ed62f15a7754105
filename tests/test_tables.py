"""Logs of a small made-up corpus to tables to reports."""

import json
import random
from datetime import datetime, timedelta

import pytest

from ledgerline.__main__ import parsed, run
from ledgerline.plans import commands as cmd
from ledgerline.plans import tables

MODELS = ["claude-opus-4-6", "claude-sonnet-4-6", "<synthetic>", "unlisted"]


def corpus(root, seed=3, sessions=6):
    """Sessions of prompts and streamed answers; the last continues the first, whose lines it repeats. Gives the cost-free
    truth: the best line of each request."""
    rng, best = random.Random(seed), {}
    files = {}
    for s in range(sessions):
        sid, lines, parent = f"s{s}", [], None
        for t in range(rng.randrange(2, 6)):
            at = lambda k: (datetime(2024, 1, 1 + s) + timedelta(minutes=10 * t, seconds=k)).isoformat() + "Z"  # noqa: E731, B023
            lines.append({"type": "user", "uuid": f"{sid}-u{t}", "parentUuid": parent, "sessionId": sid, "timestamp": at(0), "message": {"content": f"/fix part {t}" if t % 2 else "please look at the code"}})
            rid, model = f"r-{sid}-{t}", rng.choice(MODELS)
            for k in range(rng.randrange(1, 4)):
                usage = {"input_tokens": 100, "output_tokens": rng.randrange(1, 500), "cache_creation_input_tokens": 10, "cache_read_input_tokens": 1000}
                line = {"type": "assistant", "uuid": f"{sid}-a{t}-{k}", "parentUuid": f"{sid}-u{t}" if k == 0 else f"{sid}-a{t}-{k - 1}", "sessionId": sid, "timestamp": at(k + 1), "requestId": rid, "message": {"id": f"m-{rid}", "model": model, "stop_reason": "end_turn" if k == 0 else None, "content": [{"type": "text", "text": f"answer {k}"}], "usage": usage}}
                lines.append(line)
                old = best.get(rid)
                if old is None or (k == 0, usage["output_tokens"]) > old[1]:
                    best[rid] = (model, (k == 0, usage["output_tokens"]), sid)
            parent = lines[-1]["uuid"]
        files[sid] = lines
    repeated = [{**x, "sessionId": "s9", "uuid": x["uuid"].replace("s0", "s9"), "parentUuid": (x["parentUuid"] or "").replace("s0", "s9") or None} for x in files["s0"]]
    more = {**repeated[1], "uuid": "s9-more", "requestId": "r-s9-new", "message": {**repeated[1]["message"], "id": "m-new"}}
    files["s9"] = [*repeated, more]
    best["r-s9-new"] = (more["message"]["model"], (True, more["message"]["usage"]["output_tokens"]), "s9")
    for sid, lines in files.items():
        folder = root / f"-home-u-p{len(sid)}"
        folder.mkdir(exist_ok=True)
        (folder / f"{sid}.jsonl").write_text("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines) + '{"type":"progress"}\nnot json\n')
    for rid, (model, rank, sid) in list(best.items()):
        best[rid] = (model, rank, "s9" if sid == "s0" else sid)
    return best


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    best = corpus(root)
    out = str(tmp_path_factory.mktemp("tables"))
    tables.write(tables.build(spark, str(root)), out, "main")
    return tables.load(spark, out, "main"), best, root, out


def test_requests(built):
    t, best, _, _ = built
    got = {r["id"]: (r["model"], r["output_tokens"], r["session_id"]) for r in t.requests.collect()}
    assert got == {k: (m, rank[1], s) for k, (m, rank, s) in best.items()}


def test_sessions(built):
    t = built[0]
    got = {r["session_id"]: (r["visible"], r["project"], r["title"]) for r in t.sessions.collect()}
    assert got["s9"][0] and not got["s0"][0] and all(v[0] for k, v in got.items() if k != "s0")
    assert got["s1"][1:] == ("-home-u-p2", "please look at the code")


def test_turns_and_skills(built):
    t = built[0]
    prompts = t.steps.where("kind = 'prompt'").count()
    assert t.turns.count() == prompts and {r["skill"] for r in t.skills.collect()} == {"fix"}
    assert {r["rejection"] for r in t.diagnostics.collect()} == {"filtered", "malformed"}


def test_commands(built):
    t, best, _, _ = built
    billable = [v for v in best.values() if v[0] != "<synthetic>"]
    row = cmd.summary(t).first()
    assert row["requests"] == len(billable) and row["output_tokens"] == sum(v[1][1] for v in billable)
    assert sum(r["requests"] for r in cmd.periods(t, "day").collect()) == len(billable)
    assert cmd.periods(t, "week", limit=1).count() == 1
    assert {r["model"]: r["requests"] for r in cmd.models(t).collect()} == {m: sum(v[0] == m for v in billable) for m in {v[0] for v in billable}}
    assert cmd.projects(t).count() == 1 and cmd.skills(t).first()["skill"] == "fix"
    assert cmd.search(t, "look").count() > 0 and cmd.search(t, "nowhere").count() == 0
    assert cmd.summary(t, datetime(2030, 1, 1)).first()["requests"] == 0
    report, found = cmd.verify(t)
    assert not found.where("severity = 'error'").collect(), report.collect()


def test_command_line(spark, built, tmp_path, capsys):
    out = built[3]
    assert run(spark, parsed(["models", "--tables", out, "--json", "--limit", "1"])) == 0
    assert len(json.loads(capsys.readouterr().out)) == 1
    assert run(spark, parsed(["budget", "0", "--tables", out])) == 4
    assert run(spark, parsed(["daily", "--tables", out, "--csv", f"{tmp_path}/csv"])) == 0
    assert run(spark, parsed(["verify", "--tables", out])) == 0
    with pytest.raises(ValueError):
        run(spark, parsed(["summary", "--tables", out, "--last", "7d", "--month", "2024-01"]))
