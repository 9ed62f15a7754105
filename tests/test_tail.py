"""The byte-range source: appended, truncated, removed and restarted logs, heads, ranges, samples."""

import json
import os
import random
from datetime import datetime, timezone

import pytest

from ledgerline.sources import tail as T


def write(path, lines, mode="ab", end=b"\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(b"\n".join(x.encode() for x in lines) + end)


def drain(spark, logs, base):
    """What one run to the end delivers, by a new query that goes on from the checkpoint."""
    got = []

    def take(df, _):
        got.extend((os.path.basename(r["path"]), r["offset"], r["value"]) for r in df.collect())

    T.tailed(spark, logs, range_bytes=7).writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted(got)


def test_appended_lines_come_once_over_restarts(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(f"{logs}/a.jsonl", ["one", "two", "thréé"])
    write(f"{logs}/p/b.jsonl", ["x" * 50, ""])
    write(f"{logs}/c.txt", ["no"])
    assert drain(spark, logs, tmp_path) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "thréé"), ("b.jsonl", 0, "x" * 50), ("b.jsonl", 51, "")]
    assert drain(spark, logs, tmp_path) == []
    write(f"{logs}/a.jsonl", ["four", "fi"], end=b"")  # the last line is not closed yet
    assert drain(spark, logs, tmp_path) == [("a.jsonl", 16, "four")]
    write(f"{logs}/a.jsonl", ["ve"])
    write(f"{logs}/d.jsonl", ["new"])
    assert drain(spark, logs, tmp_path) == [("a.jsonl", 21, "five"), ("d.jsonl", 0, "new")]
    write(f"{logs}/a.jsonl", ["one", "again"], "wb")  # truncated: another file
    os.remove(f"{logs}/d.jsonl")
    assert drain(spark, logs, tmp_path) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "again")]
    write(f"{logs}/a.jsonl", ["other", "text that is longer than before"], "wb")  # replaced by a longer one
    write(f"{logs}/d.jsonl", ["new"])  # back
    assert drain(spark, logs, tmp_path) == [("a.jsonl", 0, "other"), ("a.jsonl", 6, "text that is longer than before"), ("d.jsonl", 0, "new")]


def test_a_running_query_sees_files_grow(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(f"{logs}/a.jsonl", ["one"])
    query = T.tailed(spark, logs).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for k in range(3):
            query.processAllAvailable()
            assert spark.table("grown").count() == 1 + k
            write(f"{logs}/a.jsonl", [f"more {k}"])
    finally:
        query.stop()


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_ranges_give_every_line_once(tmp_path, size):
    r = random.Random(size)
    lines = ["".join(r.choice("abcé") for _ in range(r.choice([0, 1, 2, 30]))) for _ in range(60)]
    for end in (b"\n", b""):
        path = str(tmp_path / f"x{len(end)}.jsonl")
        write(path, lines + ["z"], "wb", end)
        total = os.path.getsize(path)
        got = [x for part in T.ranges(path, 0, total, size, True) for x in T.lines_of(open(path, "rb"), part)]
        want, at = [], 0
        for line in lines + ["z"]:
            want.append((at, line.encode()))
            at += len(line.encode()) + 1
        assert got == want


def entry(session, text, **more):
    return json.dumps({"type": "user", "uuid": f"u{text}", "sessionId": session, "timestamp": "2024-01-02T03:04:05Z", "message": {"role": "user", "content": text}, **more})


def test_heads_do_not_grow_with_files(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(f"{logs}/s1.jsonl", [json.dumps({"type": "x", "slug": "fast-fox"}), entry("s1", "aside", isSidechain=True), entry("s1", "first"), entry("s1", "second"), json.dumps({"type": "t", "customTitle": "Mine"})])
    write(f"{logs}/s2.jsonl", [entry("old", "go on")])
    write(f"{logs}/s3.jsonl", [entry("old", "replayed"), entry("s3", "own")])
    before = sorted(tuple(r) for r in T.read_heads(spark, logs, head_bytes=700).collect())
    meta = {os.path.basename(r["path"]): (r["session_id"], r["slug"], r["custom_title"], r["first_prompt"]) for r in T.head_metadata(T.read_heads(spark, logs, head_bytes=700)).collect()}
    assert meta == {"s1.jsonl": ("s1", "fast-fox", "Mine", "first"), "s2.jsonl": ("old", None, None, "go on"), "s3.jsonl": ("old", None, None, "replayed")}
    owners = {os.path.basename(r["path"]): r["session_id"] for r in T.owning_sessions(spark, T.head_metadata(T.read_heads(spark, logs)), logs).collect()}
    assert owners == {"s1.jsonl": "s1", "s2.jsonl": "old", "s3.jsonl": "s3"}
    write(f"{logs}/s1.jsonl", [entry("s1", "x" * 1000)] * 100)  # a hundred times as long
    assert sorted(tuple(r) for r in T.read_heads(spark, logs, head_bytes=700).collect()) == before


def test_heads_read_no_more_than_they_ask_for(tmp_path):
    class Counted:
        def __init__(self, path):
            self.file, self.bytes = open(path, "rb"), 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            out = self.file.read(n)
            self.bytes += len(out)
            return out

    for times in (1, 100):
        path = str(tmp_path / f"{times}.jsonl")
        write(path, ["y" * 99] * 40 * times)
        file = Counted(path)
        assert len(list(T.lines_of(file, T.ByteRange(path, 0, 1010, 0, None, True)))) == 10 and file.bytes <= 1010


def sample(day, used, account="a"):
    return json.dumps({"ts": f"2024-01-{day:02}T00:00:00Z", "account": account, "used": used, "resets_at": "2024-02-01T00:00:00Z"})


def test_sample_log(spark, tmp_path):
    log, table, check = (str(tmp_path / x) for x in ("log", "table", "check"))
    held = lambda: sorted((r["account"], r["ts"].day, r["used"]) for r in spark.read.parquet(table).collect())
    write(f"{log}/s.jsonl", [sample(1, 1.0), sample(2, 2.0), "not json", sample(2, 2.0)])
    T.append_samples(spark, log, table, check)
    assert held() == [("a", 1, 1.0), ("a", 2, 2.0)]
    write(f"{log}/s.jsonl", [sample(3, 3.0), sample(3, 4.0, "b")])
    T.append_samples(spark, log, table, check)
    T.append_samples(spark, log, table, check)
    full = sorted((r["account"], r["ts"].day, r["used"]) for r in T.parsed_samples(T.read_ranges(spark, log)).distinct().collect())
    assert held() == full and len(full) == 4
    assert T.rewrite_retained(spark, log, datetime(2024, 1, 2, tzinfo=timezone.utc)) == [(f"file://{log}/s.jsonl", 5, 1)]
    assert "not json" in open(f"{log}/s.jsonl").read() and not os.path.exists(f"{log}/s.jsonl.tmp")
    write(f"{log}/s.jsonl", [sample(4, 5.0)])
    T.append_samples(spark, log, table, check)  # the rewritten log is read anew and repeats nothing
    assert held() == [*full[:3], ("a", 4, 5.0), *full[3:]]
