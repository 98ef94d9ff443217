"""Streams with state: equal to their batch forms, state that shrinks, hand-outs that survive a crash; automata and counts."""

import random

import pytest
from pyspark.sql import functions as F

from claraudit.operators import images
from claraudit.operators import transcripts as tr
from claraudit.sources import crawl
from claraudit.streaming import focus
from claraudit.streaming import stages as sg


def _files(spark, path, rows, schema, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return sg.read_stream(spark, path)


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_rate_limit_of_requests_without_a_key(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 1 << 60]), float(i // 3), i) for i in range(300)]
    schema = "key long, at double, seq long"
    got = {r.seq: (r.key, r.accepted) for r in sg.rate_limit(spark.createDataFrame(rows, schema), limit=4, seconds=20).collect()}
    kept, want = {}, {}
    for key, at, seq in rows:
        own = kept[key] = [x for x in kept.get(key, []) if x > at - 20]
        want[seq] = (key, len(own) < 4)
        if len(own) < 4:
            own.append(at)
    assert got == want
    q = _run(sg.rate_limit_stream(_files(spark, f"{tmp_path}/in", [*rows, (9, 1e6, 1000), (9, 1e6, 1001)], schema, 4), 4, 20), "limited")
    assert {r.seq: (r.key, r.accepted) for r in spark.table("limited").collect() if r.seq < 1000} == want
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1] == 1  # timers dropped the idle keys


def test_eviction_shrinks_the_state(spark, tmp_path):
    rows = [(j, s, float(10 * j + k), 2 * j + k) for j in range(40) for k, s in enumerate(["running", "completed" if j % 4 else "running"])]
    rows += [(1, "failed", 500.0, 500), (100, "running", 50_000.0, 1000), (101, "running", 50_001.0, 1001)]
    schema = "job long, status string, at double, seq long"
    e = spark.createDataFrame(rows, schema)
    left = {r.job for r in sg.evict(sg.job_states(e), 50_001.0, 3600).collect()}
    q = _run(sg.evict_stream(_files(spark, f"{tmp_path}/in", rows, schema, 4)), "evicted")
    out = spark.table("evicted").collect()
    assert len(out) == len({r.job for r in out}) and {r.job for r in out} == {j for j in [*range(40), 100, 101]} - left
    assert {r.status for r in out} == {"completed"} and all(r.created == 10.0 * r.job for r in out)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) > sizes[-1] == len(left)


EVENTS = "job long, kind string, at double, seq long"


def test_hand_out_survives_a_crash(spark, tmp_path):
    rows = [(j, "complete" if (j, k) == (1, 2) else "start", float(10 * k + j), 10 * k + j) for k in range(6) for j in (1, 2)]
    stream = lambda: sg.read_stream(spark, f"{tmp_path}/in")
    _files(spark, f"{tmp_path}/in", rows, EVENTS, 3)
    got, calls = {"a": [], "b": [], "job": []}, []

    def sink(name, fails=()):
        def take(batch, number):
            if (name, number) in fails:
                raise RuntimeError("lost")
            calls.append((name, number))
            got[name] += [r.seq for r in batch.collect()]

        return take

    def subscribers(fails=()):
        state = spark.createDataFrame([(1, "running")], "job long, status string")
        ended = spark.createDataFrame([(2, "failed")], "job long, status string")
        return [sg.Subscriber("a", sink("a")), sg.Subscriber("b", sink("b", fails)), sg.Subscriber("job", lambda b, n: got["job"].append(b.first().status) if n < 0 else sink("job")(b, n), job=1, snapshot=state, since=5.0), sg.Subscriber("late", lambda b, n: calls.append(("late", n)), job=2, snapshot=ended)]

    with pytest.raises(Exception, match="lost"):
        sg.fan_out(stream(), subscribers({("b", 1)}), f"{tmp_path}/c").awaitTermination()
    sg.fan_out(stream(), subscribers(), f"{tmp_path}/c").awaitTermination()
    assert sorted(got["a"]) == sorted(got["b"]) == sorted(r[3] for r in rows)
    assert [n for name, n in calls if name == "a"] == [0, 1, 2]
    assert got["job"] == ["running", 11, 21]  # behind 5.0, up to the end, which closes
    assert [n for name, n in calls if name == "late"] == [-1]
    sg.fan_out(stream(), [sg.Subscriber("t", sg.table_sink(f"{tmp_path}/t"))], f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == len(rows)
    with pytest.raises(ValueError, match="one name"):
        sg.fan_out(stream(), [sg.Subscriber("x", print), sg.Subscriber("x", print)], f"{tmp_path}/c3")


def test_focus_traps(spark, tmp_path):
    logs = {1: "AAA^A", 2: "AAA^B", 3: "BAAAA^AB", 4: "ABAB^BCCC", 5: "ABCABC", 6: "AA^AAA^A^^A", 7: "^^AAAA", 8: "CCCCC", 9: "ABABAB^A"}
    rows = [(s, i, None if k == "^" else k) for s, ks in logs.items() for i, k in enumerate(ks)]
    schema = "session long, seq long, key string"
    got = {(r.session, r.seq, r.pattern, r.trapped) for r in focus.focus_traps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 2, "stuck", True), (2, 2, "stuck", False), (3, 4, "stuck", True), (4, 3, "cycle", True), (4, 8, "stuck", False), (7, 5, "stuck", False), (8, 2, "stuck", False), (8, 3, "stuck", False), (8, 4, "stuck", False), (9, 3, "cycle", False), (9, 4, "cycle", False), (9, 5, "cycle", False)}
    _run(focus.focus_traps_stream(_files(spark, f"{tmp_path}/in", sorted([*rows, *((s, 99, "z") for s in logs)], key=lambda r: r[1]), schema, 3)), "traps")
    assert {(r.session, r.seq, r.pattern, r.trapped) for r in spark.table("traps").collect()} == got


def test_otsu(spark):
    rng = random.Random(2)
    pixels = [(i, max(0, min(255, int(rng.gauss(60 if rng.random() < 0.4 else 170, 25))))) for i in range(3) for _ in range(500)] + [(7, 9)] * 5 + [(8, 0), (8, 255)]
    got = {r.image: r for r in images.otsu(spark.createDataFrame(pixels, "image long, level int"), "image").collect()}
    for image in (0, 1, 2, 8):
        own = [v for i, v in pixels if i == image]
        best = None
        for t in range(256):
            a, b = [v for v in own if v <= t], [v for v in own if v > t]
            if a and b:
                apart = len(a) * len(b) * (sum(a) / len(a) - sum(b) / len(b)) ** 2
                if best is None or apart > best[0] * (1 + 1e-12):
                    best = (apart, t, sum(a) / len(a), sum(b) / len(b))
        assert got[image].threshold == best[1] and (got[image].dark, got[image].light) == pytest.approx(best[2:])
    assert got[7].threshold is None


def test_word_errors(spark):
    rng = random.Random(5)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(90))] for _ in range(2))
        assert tr.word_errors(a, b) == table(a, b)
    rows = spark.createDataFrame([("Good  morning all", "good evening all", "en"), ("今日は晴れです", "今日は 曇りです", "ja"), (" ", "x", "en"), (None, "x", None)], "r string, t string, lang string")
    assert [r.w for r in rows.select(tr.wer("r", "t", F.col("lang")).alias("w")).collect()] == [pytest.approx(1 / 3), pytest.approx(2 / 7), None, None]


def test_crawl_of_hosts(spark):
    links = [("http://a/1", "http://a/2", 0), ("http://a/1", "http://b/1", 1), ("http://a/2", "http://a/3", 0), ("http://a/2", "http://a/1", 1), ("http://b/1", "http://b/2", 0), ("http://b/1", "http://a/9", 1), ("http://b/2", "http://b/3", 0)]
    df, seeds = spark.createDataFrame(links, "source string, target string, place int"), spark.createDataFrame([("http://a/1",), (None,)], "url string")
    policy = crawl.CrawlPolicy(max_depth=5, max_pages=3, same_origin=False)
    assert {(r.url, r.depth, r["rank"]) for r in crawl.frontier(seeds, df, policy).collect()} == {("http://a/1", 0, 0), ("http://a/2", 1, 1), ("http://b/1", 1, 0), ("http://a/9", 2, 2), ("http://b/2", 2, 1), ("http://b/3", 3, 2)}
    assert {r.url for r in crawl.frontier(seeds, df, crawl.CrawlPolicy(max_depth=1, max_pages=9)).collect()} == {"http://a/1", "http://a/2"}
    assert crawl.frontier(seeds, df, crawl.CrawlPolicy(max_depth=9, max_pages=9, max_links=1, same_origin=False)).count() == 3


def test_generated_code_stays_small(spark, capfd):
    from claraudit.plans.catalog import all_queries
    from tests.conftest import DATA

    spark.sparkContext.setLogLevel("WARN")
    try:
        for name in ("join_nearest_gap", "join_offset_exception", "chk_orientation", "ext_moving_css"):
            all_queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert "grows beyond 64 KB" not in capfd.readouterr().err


def test_snapshot_without_earlier_events(spark, tmp_path):
    from claraudit.plans.q_stream import QUERIES
    from tests.conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    for name, job in (("late", 7), ("other", 8)):  # the job's first event comes after the snapshot, or it has none
        rows = events.filter("event_id < 50").withColumn("event_id", F.col("event_id") + 5000).withColumn("user_id", F.lit(job).cast("long"))
        rows.write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = QUERIES["st_snapshot_then_tail"](spark, f"{tmp_path}/{name}").collect()
        assert [tuple(r) for r in got] == [(0, "running", 1)]
