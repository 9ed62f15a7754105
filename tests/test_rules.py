"""Periods, prices, text functions, efficiency, sinks, storage, streams."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import periods as P
from ledgerline.functions import text as X
from ledgerline.functions.pricing import price, split_cache_writes
from ledgerline.operators import dedup as D
from ledgerline.operators import efficiency as E
from ledgerline.operators import search as Q
from ledgerline.operators import verify as V
from ledgerline.sources import roots, sinks
from ledgerline.streaming import refresh

NOW = datetime(2024, 3, 31, 15, 30)


def test_periods():
    assert P.resolve(NOW, last="7d") == (NOW - timedelta(days=7), NOW)
    assert P.resolve(NOW, last="1m")[0] == datetime(2024, 2, 29, 15, 30)
    assert P.resolve(NOW, month="2024-02") == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999000))
    assert P.resolve(NOW, since="2024-01-02", until="2024-01-01")[1] < P.resolve(NOW, since="2024-01-02")[0]
    assert P.resolve(NOW) == (None, None)
    for bad in ({"last": "0d"}, {"last": "7x"}, {"month": "2024-13"}, {"since": "2024/01/01"}, {"last": "7d", "month": "2024-01"}, {"since": "2024-1-1"}):
        with pytest.raises(ValueError):
            P.resolve(NOW, **bad)
    assert P.named_range("yesterday", NOW) == (datetime(2024, 3, 30), datetime(2024, 3, 30, 23, 59, 59, 999000))
    assert P.named_range("thisWeek", NOW)[0] == datetime(2024, 3, 25)
    assert P.named_range("thisWeek", NOW, first_weekday=6)[0] == datetime(2024, 3, 31)
    assert P.named_range("custom", NOW, custom=(date(2024, 1, 3), date(2024, 1, 1))) == (datetime(2024, 1, 1), datetime(2024, 1, 3, 23, 59, 59))


REQUEST = "id long, session_id string, model string, speed string, input_tokens long, output_tokens long, reasoning_tokens long, cache_1h long, cache_5m long, cache_read long"


def test_prices(spark):
    rows = [(1, "s", "claude-opus-4-6", None, 1_000_000, 0, 0, 0, 0, 0), (2, "s", "claude-opus-4-6", "fast", 0, 1_000_000, 0, 0, 0, 0), (3, "s", "claude-sonnet-9", "fast", 1, 1, 0, 0, 0, 0), (4, "s", "gpt-5.5", None, 300_000, 0, 0, 0, 0, 0), (5, "s", "gpt-5.5", None, 1_000_000, 0, 1_000_000, 0, 0, 0), (6, "t", "gpt-5.5", None, 272_000, 0, 0, 0, 0, 0), (7, "t", "<synthetic>", None, 5, 5, 0, 0, 0, 0), (8, "t", None, None, 5, 5, 0, 0, 0, 0), (9, "t", "other", None, 5, 5, 0, 0, 0, 0)]
    got = {r["id"]: r["cost_usd"] for r in price(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got[1] == 5.0 and got[2] == 150.0 and got[3] is None  # no fast rates
    assert got[4] == pytest.approx(3.0) and got[5] == pytest.approx(10.0 + 45.0)
    assert got[6] == pytest.approx(1.36) and got[7] is None and got[8] is None and got[9] is None
    writes = spark.createDataFrame([(10, 3, 0), (10, None, None), (10, 0, 0), (None, None, None)], "flat long, hour long, five long").select(*split_cache_writes(F.col("flat"), F.col("hour"), F.col("five")))
    assert [tuple(r) for r in writes.collect()] == [(3, 0), (0, 10), (0, 10), (0, 0)]


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_text(spark):
    x = lambda c, v: one(spark, c(F.col("t")), t=v)
    assert x(X.skill_name, "  /fix all of it") == "fix" and x(X.skill_name, "say /fix") is None
    assert x(X.dollar_skill, "$flow-all go") == "flow-all" and x(X.dollar_skill, "$HOME is") is None and x(X.dollar_skill, "$imagegen") == "imagegen"
    assert x(X.dollar_skill, "# Files\nx\n## My request for Codex:\n\n[$flow](/a/skills/flow/SKILL.md) go") == "flow"
    assert x(X.dollar_skill, "[$flow](/a/flow/README.md) go") is None
    assert x(lambda c: X.dollar_skill(c, ["plan"]), "$plan it") == "plan"
    assert x(X.file_paths, "see @/a/b.py, (/c/d.tar.gz) and `/not/this.py` /no/ext /e\\ f/g.md.") == ["/a/b.py", "/c/d.tar.gz", "/e f/g.md"]
    assert x(X.clean_prompt, "a\nb [Image #1] @/x/y.py  c") == "a b 🖼 @y.py c"
    assert x(X.truncated, "a" * 60) == "a" * 50 + "…"
    assert [x(X.project_label, v) for v in ("/a/b", "-home-u-app", "plain", "/a/b/", "")] == ["b", "app", "plain", "b", ""]
    assert [x(X.decoded_path, v) for v in ("-home-u--x", "", "ab")] == ["/home/u/_x", "/", "/ab"]
    assert [x(X.is_short, v) for v in ("ok", " Okay ", "do it", "fix", "")] == [True, True, False, True, False]
    assert [x(X.short_model, v) for v in ("claude-opus-4-6", "claude-3-5-sonnet-20241022", "gpt-5.1-codex-mini", "gpt-oss", "codex-mini-latest", "other")] == ["opus-4-6", "sonnet-3.5", "GPT-5.1 Codex Mini", "GPT-OSS", "Codex Mini Latest", "other"]
    assert [one(spark, X.compact_cost(F.col("v")), v=v) for v in (0.0001, 0.1234, 12.344, 250.4)] == ["<$0.001", "$0.123", "$12.34", "$250"]
    assert [one(spark, X.compact_number(F.col("v")), v=v) for v in (999, 1500, 2_500_000)] == ["999", "1.5k", "2.5M"]
    assert one(spark, X.tool_summary(F.lit("Read"), F.col("a")), a='{"file_path":"/a/b.py"}') == "b.py"
    assert one(spark, X.tool_skill(F.lit("Skill"), F.col("a")), a='{"command":"/go"}') == "go"


def test_lineage_order_does_not_matter(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 9), ("d", 3), ("d", 4), ("d", 5), ("d", 6)]
    want = {("a", True, "b"), ("b", False, "b"), ("c", False, "c"), ("d", False, "d")}
    for order in (rows, rows[::-1]):
        got = D.lineage(spark.createDataFrame(order, "session_id string, request_id long"))
        assert {(r["session_id"], r["hidden"], r["canonical"]) for r in got.collect()} == want


def test_ties_keep_the_earlier_or_the_later_line(spark):
    lines = spark.createDataFrame([("s", 1, None, 5, 1, 0), ("s", 1, "end_turn", 2, 1, 1), ("s", 1, "end_turn", 2, 1, 2)], "session_id string, k long, stop_reason string, output_tokens long, input_tokens long, place long")
    assert D.best_entries(lines, ["session_id", "k"]).first()["place"] == 1
    assert D.last_best_entries(lines, ["session_id", "k"]).first()["place"] == 2


SAMPLE = "account long, ts timestamp_ntz, used double, resets_at timestamp_ntz"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_efficiency(spark):
    reset, later = at(300), at(600)
    samples = spark.createDataFrame([(1, at(0), 10.0, reset), (1, at(10), 9.0, reset), (1, at(20), 12.0, reset), (1, at(30), 12.0, reset), (1, at(40), 2.0, later), (1, at(50), 4.0, later), (1, at(400), 9.0, later)], SAMPLE)
    costs = spark.createDataFrame([(1, at(0), 100.0), (1, at(15), 1.0), (1, at(20), 3.0), (1, at(45), 0.5), (1, at(399), 9.0)], "account long, ts timestamp_ntz, cost_usd double")
    kept = [(r["ts"], r["used"]) for r in E.canonical(samples).orderBy("ts").collect()]
    assert kept == [(at(0), 10.0), (at(20), 12.0), (at(40), 2.0), (at(50), 4.0), (at(400), 9.0)]
    pairs = [(r["ts"], r["d_limit"], r["d_cost"]) for r in E.ratio_pairs(samples, costs).orderBy("ts").collect()]
    assert pairs == [(at(20), 2.0, 4.0), (at(50), 2.0, 0.5)]  # a fall and a gap over four hours are left out
    hours = {r["hour"]: r for r in E.by_hour_of_day(samples, costs).collect()}
    assert len(hours) == 24 and hours[0]["samples"] == 2 and hours[5]["shrunk_ratio"] == 0
    assert hours[0]["shrunk_ratio"] == pytest.approx((0.5 + 4 + 10 * 2.25) / 12)


def test_anomalies_run_together(spark):
    rows = [(1, h, 5, 1.0) for h in range(10)] + [(1, 10, 5, 2.0), (1, 11, 5, 3.0), (1, 13, 5, 0.5), (1, 14, 1, 9.0)]
    buckets = spark.createDataFrame(rows, "account long, hour int, samples long, shrunk_ratio double")
    got = sorted((r["direction"], r["start_hour"], r["end_hour"], r["multiplier"]) for r in E.anomalies(buckets).collect())
    assert got == [("high", 10, 11, 2.5), ("low", 13, 13, 0.5)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "s", "The quick fox-trot"), (2, "s", "quick quick"), (3, "t", "slow fox"), (4, "t", None)], "doc long, session_id string, text string")
    find = lambda q: sorted(r["doc"] for r in Q.matches(docs, q).collect())
    assert find("qui") == [1, 2] and find("fox qui") == [1] and find("fox-tr") == [1] and find("trot-fox") == [] and find("  ") == []
    best = Q.ranked(docs, "quick").collect()
    assert [r["doc"] for r in best] == [2, 1] and best[0]["score"] > best[1]["score"]
    assert [(r["session_id"], r["hits"]) for r in Q.session_hits(Q.ranked(docs, "fox")).collect()] == [("t", 1), ("s", 1)]
    assert [tuple(h) for h in one(spark, Q.highlights(F.col("t"), "ab"), t="xAbab")] == [(1, 2), (3, 2)]


def test_no_drift_without_changes(spark):
    rows = [("s", 1, 1, 1, "end_turn", "claude-opus-4-6", "standard", 10, 20, 0, 1, 2, 3), ("s", 1, 2, 2, None, "claude-opus-4-6", "standard", 10, 5, 0, 1, 2, 3), ("s", 2, 3, 3, None, "other", "standard", 1, 1, 0, 0, 0, 0)]
    lines = spark.createDataFrame(rows, "session_id string, request_id long, uuid long, place long, stop_reason string, model string, speed string, input_tokens long, output_tokens long, reasoning_tokens long, cache_1h long, cache_5m long, cache_read long")
    truth = V.session_truth(lines)
    assert truth.first()["cost_usd"] == pytest.approx((10 * 5 + 20 * 25 + 10 + 2 * 6.25 + 3 * 0.5) / 1e6)
    found = V.divergences(truth.drop("raw_lines", "unpriced"), truth)
    assert [(r["kind"], r["severity"]) for r in found.collect()] == [("unknown-pricing", "warning")] and not V.drifted(found)
    assert V.drifted(V.divergences(truth.where("false"), truth))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1.5, 2), ("a\x07b", None, None)], "b string, a double, c long")
    assert [tuple(r) for r in sinks.csv_cells(df).collect()] == [("'=1+1", "1.500000", "2"), ("ab", None, None)]
    assert json.loads(sinks.json_lines(df).first()["value"]) == {"a": 1.5, "b": "=1+1", "c": 2}
    assert sinks.report_table(df.limit(1)) == "b          a  c\n=1+1  1.5000  2"
    with pytest.raises(ValueError):
        sinks.report_json(df, most=1)
    sinks.replace_sources(spark.createDataFrame([(1, "x"), (2, "y")], "source_id long, v string"), f"{tmp_path}/t")
    sinks.replace_sources(spark.createDataFrame([(2, "z")], "source_id long, v string"), f"{tmp_path}/t")
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["x", "z"]


def test_roots():
    known = roots.add_source([], "main", "a", "/x")
    assert roots.add_source(known, "main", "a", "/y")[1].name == "main 2"
    with pytest.raises(ValueError):
        roots.add_source(known, "other", "a", "/x/")
    assert roots.infer_kind(["projects"]) == "a" and roots.infer_kind([]) is None and roots.scoped("b", "b:1") == roots.scoped("b", "1")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0), 1.0, at(300)), (1, at(1), 5.0, at(300)), (1, at(2), 3.0, at(300)), (1, at(3), 2.0, at(600)), (1, at(4), 2.0, at(600))], "account string, ts timestamp, used double, resets_at timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = refresh.rising_samples(stream).writeStream.format("memory").queryName("rising").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["used"] for r in spark.table("rising").collect()) == [1.0, 2.0, 5.0]

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("x\ny\n")
    lines = refresh.stream_lines(spark, str(tmp_path / "logs")).withColumn("source_id", F.regexp_extract("path", "([^/]+)$", 1))
    rebuild = lambda keys: keys.withColumn("n", F.lit(1))
    run = refresh.recompute_touched(lines, "source_id", rebuild, f"{tmp_path}/out", f"{tmp_path}/c2")
    run.processAllAvailable()
    (tmp_path / "logs" / "b.jsonl").write_text("z\n")
    run.processAllAvailable()
    run.stop()
    assert sorted(r["source_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a.jsonl", "b.jsonl"]


def test_changed_files(spark, tmp_path):
    files = spark.createDataFrame([("/a", 1, at(0), 1), ("/b", 2, at(0), 2)], "path string, size long, modified timestamp, source_id long")
    rebuild = lambda keys: keys.withColumn("v", F.col("source_id") * 10)
    old = spark.createDataFrame([("/gone", "x", 3)], "path string, fingerprint string, source_id long")
    sinks.replace_sources(spark.createDataFrame([(3, 30)], "source_id long, v long"), f"{tmp_path}/t")
    manifest, gone = refresh.refresh_changed(files, old, rebuild, f"{tmp_path}/t")
    assert [r["path"] for r in gone.collect()] == ["/gone"]
    refresh.refresh_changed(files.withColumn("size", F.when(F.col("path") == "/b", 3).otherwise(F.col("size"))), manifest, lambda keys: keys.withColumn("v", F.lit(-1)), f"{tmp_path}/t")
    spark.catalog.refreshByPath(f"{tmp_path}/t")
    assert sorted((r["source_id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 10), (2, -1)]


def test_windowed_streams(spark, tmp_path):
    rows = spark.createDataFrame([(at(0), "m", 1.0, "s"), (at(1), "m", 2.0, "s"), (at(100), "m", 4.0, "s"), (at(900), "m", 0.0, "t")], "timestamp timestamp, model string, cost_usd double, session_id string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, make, want in (("spend", refresh.windowed_spend, [2, 1]), ("spells", refresh.active_spells, [2, 1])):
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        run.processAllAvailable()
        run.stop()
        assert sorted((r["requests"] for r in spark.table(name).collect()), reverse=True) == want


@pytest.mark.parametrize("query", ["fox", "qui bro", "quick-bro", "the-quick fox", "nowhere", "", "fox-x"])
def test_index_answers_as_texts_do(spark, query):
    """Terms, prefixes and phrases, by the index and by the texts themselves."""
    rows = [(1, "The quick brown fox"), (2, "quick the brown fox, the quick bro"), (3, "foxes are quick. Brown ones"), (4, None), (5, ""), (6, "fox fox x quick brow")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    postings, lengths = Q.build_index(docs)
    shown = lambda df: [(r["doc"], round(r["score"], 9), r["snippet"]) for r in df.collect()]
    want = shown(Q.ranked(docs, query))
    assert shown(Q.index_ranked(postings, lengths, docs, query)) == want
    assert sorted(d for d, _, _ in want) == sorted(r["doc"] for r in Q.matches(docs, query).collect())


def test_series_have_no_cap_unless_asked(spark):
    from ledgerline.operators import timeline as T

    rows = [(datetime(2010, 1, 1), 1.0, 1, 1, 1, 1), (datetime(2024, 1, 1), 2.0, 1, 1, 1, 1)]
    buckets = spark.createDataFrame(rows, "bucket timestamp_ntz, cost_usd double, sessions long, turns long, requests long, tokens long")
    assert T.gap_filled(buckets, "day").agg(F.count("*"), F.sum("cost_usd")).first()[:] == (5114, 3.0)
    assert T.gap_filled(buckets, "day", most=T.CHART_CAPS["day"]).count() == 3650
