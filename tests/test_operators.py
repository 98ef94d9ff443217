"""Operators that SQL can't check, and properties of those that it can."""

import random

import pytest
from pyspark.sql import functions as F

from claraudit.functions import text, urls
from claraudit.operators import findings as fi
from claraudit.operators import sensory
from claraudit.operators import transcripts as tr
from claraudit.sources import crawl, sinks
from claraudit.sources.catalogue import catalogue, keyword_terms
from claraudit.streaming import stages as sg


def test_word_errors(spark):
    def slow(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    rng = random.Random(1)
    pairs = [tuple(" ".join(rng.choice(["Ab", "b", "ç", "dd"]) for _ in range(rng.randrange(1, 9))) for _ in range(2)) for _ in range(200)]
    rows = spark.createDataFrame([*pairs, ("", "x"), ("x", None), (None, None)], "a string, b string")
    for r in rows.select("a", "b", tr.wer("a", "b").alias("w")).collect():
        assert r.w == (slow(r.a.lower().split(), r.b.lower().split()) / len(r.a.split()) if r.a and r.b else None)


@pytest.mark.parametrize(("url", "want"), [("HTTP://A.Example/x/?b=2&a=1&utm_source=q#top", "http://a.example/x?a=1&b=2"), ("https://h/", "https://h/"), ("https://h/?flag&gclid=1", "https://h/?flag"), ("", "")])
def test_normalize(spark, url, want):
    assert spark.range(1).select(urls.normalize(F.lit(url)).alias("u")).first().u == want


def test_same_origin(spark):
    rows = [("http://h:80/a", "http://h/b", True), ("https://h/a", "http://h/b", False), ("", "http://h", True), ("about:blank", "http://h", True), ("http://x.h/", "http://h/", False)]
    out = spark.createDataFrame(rows, "a string, b string, want boolean").select(urls.same_origin(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


def _findings(spark, rows):
    schema = "source string, wcag_sc string, status string, pos long, selector string, severity string"
    return fi.make_findings(spark.createDataFrame(rows, schema), catalogue(spark))


def test_merge(spark):
    rows = [("axe", "1.1.1", "fail", 0, "#a", None), ("python", "1.1.1", "fail", 1, "#A ", None), ("python", "1.1.1", "fail", 2, "#a", None), ("axe", "1.4.3", "fail", 3, "#a", None), ("axe", "1.4.3", "fail", 4, "#a", None), ("axe", "9.9", "pass", 5, None, None), ("python", "9.9", "pass", 6, None, None)]
    once = fi.merge_findings(_findings(spark, rows))
    assert {r.pos for r in once.collect()} == {2, 3, 5, 6}
    again = fi.merge_findings(once.drop("merged_pos"))
    assert {r.pos for r in again.collect()} == {2, 3, 5, 6}


def test_keyword_pattern():
    assert text.keyword_pattern([]) is None
    assert text.keyword_pattern(["go", "go on", "a.b"]) == r"go\ on|a\.b|go"
    assert keyword_terms({"checks": {"c": {"a": {"en": ["x", "y"], "ja": ["y", "z"]}}}}, "c", "a") == ["x", "y", "z"]


def test_crawl_frontier(spark):
    links = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "a", 0), ("d", "e", 0)], "source string, target string, place int")
    seeds = spark.createDataFrame([("a",)], "url string")
    out = {r.url: r.depth for r in crawl.bfs(seeds, links, max_depth=2, max_pages=10).collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert crawl.bfs(seeds, links, max_depth=5, max_pages=3).count() == 3


def test_stage_stream_equals_batch(spark, tmp_path):
    rows = [(1, "s", "start", 1.0, 0), (1, "s", "complete", 2.0, 1), (1, "s", "error", 2.5, 2), (1, "s", "start", 3.0, 3), (2, "t", "start", 1.0, 4), (2, "t", "error", 4.0, 5)]
    e = spark.createDataFrame(rows, "job long, stage string, kind string, at double, seq long")
    batch = {tuple(r) for r in sg.stage_records(e).filter("status <> 'running'").collect()}
    e.orderBy("seq").coalesce(1).write.parquet(f"{tmp_path}/in")
    q = sg.stage_stream(sg.read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("stages").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("stages").collect()} == batch


def test_rate_limit(spark, tmp_path):
    rows = [(1, float(i), i) for i in range(5)] + [(1, 61.0, 5), (2, 0.0, 6)]
    r = spark.createDataFrame(rows, "key long, at double, seq long")
    got = {x.seq: x.accepted for x in sg.rate_limit(r, limit=3, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True}
    r.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = sg.rate_limit_stream(sg.read_stream(spark, f"{tmp_path}/in"), 3, 60).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {x.seq: x.accepted for x in spark.table("limits").collect()} == got


def test_fan_out_and_log(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen: list[int] = []
    sg.fan_out(sg.read_stream(spark, f"{tmp_path}/in"), [lambda d, _: seen.append(d.count()), lambda d, _: seen.append(d.count())], f"{tmp_path}/c1").awaitTermination()
    assert sum(seen) == 10
    sg.step_log(sg.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").count() == 5


def test_sinks_and_records(spark, tmp_path):
    f = _findings(spark, [("axe", "1.1.1", "fail", 0, "#a", "high")])
    sinks.write_json(f, f"{tmp_path}/j")
    sinks.write_csv(f.drop("element"), f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/j").count() == spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 1
    raw = spark.createDataFrame([("p", '{"tag": "a", "width": 3.5}'), ("p", '{"tag": "a", "width": "wide"}'), (None, "{")], "page_url string, body string")
    good, bad = sinks.normalize_records(raw, "tag string, width double", "http://d/")
    assert [(r.page_url, r.tag, r.width) for r in good.collect()] == [("p", "a", 3.5)]
    assert {r.code for r in bad.collect()} == {"normalization_error"} and bad.count() == 2


def test_sensory_instructions(spark):
    texts = ["Click the round green button on the right.", "Press the red Save button. It rained.", "The red house is big.", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {(r.k, r.categories, r.residual, r.status) for r in sensory.findings(rows).collect()}
    assert got == {(0, "color,shape,position", "", "FAILED"), (1, "color", "Save", "PASSED")}


SENSORY = [
    ("Click the round button to continue.", "shape", "FAILED"),
    ("Click the blue Submit button.", "color", "PASSED"),
    ("Required fields are marked in red.", "color", "FAILED"),
    ("Press the arrow on the right to continue.", "position", "FAILED"),
    ('Click the "Submit" button on the right.', "position", "PASSED"),
    ("Select the item on the left.", "position", "FAILED"),
    ("Then press the big one at the top.", None, None),  # neither a verb in front nor a control
    ("The round button is disabled.", None, None),
    ("See 42 on the right side.", "position", "PASSED"),
    ("See it", None, None),
    ("赤いボタンをクリックしてください", "color", "FAILED"),
    ("「送信」ボタンの右をクリックして", "position", "PASSED"),
    ("赤い確認ボタンをクリック", "color", "PASSED"),
    ("右の blue ボタンをクリック", "position,color", "PASSED"),
    ("赤いボタンは昨日の話", None, None),
]


def test_sensory_languages_and_sources(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SENSORY)], "k int, text string")
    got = {r.k: (r.categories, r.status) for r in sensory.findings(rows).collect()}
    assert got == {i: (c, s) for i, (_, c, s) in enumerate(SENSORY) if c}
    # Japanese sentences need no space between them; the language of the element goes before what its text looks like
    rows = [(0, "赤いボタンをクリック。左のタブを選択します。", None), (1, "Tap 右", "en"), (2, "Tap 右", "ja-JP")]
    got = sorted((r.k, r.sentence, r.categories) for r in sensory.findings(spark.createDataFrame(rows, "k int, text string, lang string")).collect())
    assert got == [(0, "左のタブを選択します。", "position"), (0, "赤いボタンをクリック。", "color")]
    # every text of an element, each once
    rows = spark.createDataFrame([(0, "Go", "Click the red one", "Click the red one", None)], "k int, text string, aria_label string, title string, value string")
    assert [(r.sentence, r.status) for r in sensory.findings(rows).collect()] == [("Click the red one", "PASSED")]


def test_boxes_of_full_pages(spark):
    import random

    from claraudit.operators import boxes as bx

    rng = random.Random(4)
    page = lambda p, n, span: [(p, i, float(rng.randrange(-50, span)), float(rng.randrange(span)), float(rng.choice([0, 6, 12, 30, 90])), float(rng.choice([5, 20, 60]))) for i in range(n)]
    rows = [*page(1, 620, 3000), *page(2, 40, 100_000), *page(3, 1, 10), (1, 620, -100.0, -100.0, 4000.0, 5000.0), (4, 0, 0.0, 0.0, 9.0, 9.0), (4, 1, 12.5, 300_000.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page long, id long, x double, y double, w double, h double")
    plain = df.filter("not (page = 1 and id = 620)")  # without the box behind all others
    gap = lambda p, q, i: max(0.0, q[2 + i] - p[2 + i] - p[4 + i], p[2 + i] - q[2 + i] - q[4 + i])
    meet = lambda p, q, r=(0, 0): all(p[2 + i] - r[i] < q[2 + i] + q[4 + i] and p[2 + i] + p[4 + i] + r[i] > q[2 + i] for i in (0, 1))
    few = [r for r in rows if (r[0], r[1]) != (1, 620)]
    others = lambda p, all_: [q for q in all_ if q[0] == p[0] and q[1] != p[1]]
    assert {(r.page, r.id): r.gap for r in bx.nearest_gap(plain).collect()} == {p[:2]: min((max(gap(p, q, 0), gap(p, q, 1)) for q in others(p, few)), default=0.0) for p in few}
    truth = {}
    for p in few:
        o, r = others(p, few), [max(0.0, 12 - p[4 + i] / 2) for i in (0, 1)]
        truth[p[:2]] = (*(min((gap(p, q, i) for q in o), default=None) for i in (0, 1)), (p[4] < 24 or p[5] < 24) and not any(meet(p, q, r) for q in o))
    assert {(r.page, r.id): (r.gap_x, r.gap_y, r.offset_exception) for r in bx.offset_exception(plain).collect()} == truth
    pairs = bx.overlapping_pairs(df).collect()
    assert sorted((r.page, r.a, r.b) for r in pairs) == sorted((p[0], p[1], q[1]) for p in rows for q in others(p, rows) if p[1] < q[1] and meet(p, q))
    over = [r for r in rows if r[1] % 3 == 0 or r[1] == 620]
    truth = {}
    for p in rows:
        shares = [0.0, *(max(0.0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2])) * max(0.0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])) / (p[4] * p[5]) for q in others(p, over) if p[4])]
        truth[p[:2]] = (round(min(1.0, max(shares)), 3), sum(x > 0.05 for x in shares))
    assert {(r.page, r.id): (round(r.ratio, 3), r.n_covering) for r in bx.obscuration(df, df.filter("id % 3 = 0 or id = 620")).collect()} == truth


def test_html_reader(spark):
    from claraudit.sources import html

    deep = "<div hidden>" + "<div>" * 30 + "<input name=deep>" + "</div>" * 31
    page = f"<ul><li>one<li>two<li>three</ul><p>a<p>b <b>c</b><div>d</div>{deep}<label>L{'<i>' * 20}<input name=far>{'</i>' * 20}</label><table><tr><td>x<td>y<tr><td>z</table><select><option>1<option>2</select>"
    rows = html.elements(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    of = lambda tag: [r.text for r in rows if r.tag == tag]
    assert of("li") == ["one", "two", "three"] and of("p") == ["a", "b c"] and of("td") == ["x", "y", "z"] and of("option") == ["1", "2"] and of("tr") == ["xy", "z"]
    assert {r.attrs["name"]: r.hidden for r in rows if r.tag == "input"} == {"deep": True, "far": False}
    fields = html.forms(html.elements(spark.createDataFrame([(1, page)], "page_id long, html string"))).collect()
    assert [(f.name, f.label_text) for f in fields if f.name == "far"] == [("far", "L")]


def test_html_reader_takes_linear_time():
    import time

    from claraudit.sources.html import _Reader

    def took(n):
        r, at = _Reader(), time.perf_counter()
        r.feed("<p>word " * n + "<b>" * n)
        r.done()
        return time.perf_counter() - at

    took(1000)
    assert took(16000) < 40 * took(2000)


def test_links_equal_the_parser(spark):
    import html as entities

    from claraudit.operators import page_links
    from claraudit.sources import html
    from tests.conftest import DATA

    odd = """<A HREF='/a'>one</A><a class=x href=/b>two <b>bold</b></a><a
      href = "/c?x=1&amp;y=2">three
      four</a><a name="n">none</a><a href="">empty</a>"""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame([(-1, "http://h/", odd)], "page_id long, url string, html string"))
    got = {(r.page_id, r.pos, entities.unescape(r.href)) for r in page_links.links(pages).collect()}
    want, n = set(), {}
    for r in html.elements(pages).filter("tag = 'a' and attrs['href'] is not null").orderBy("page_id", "pos").collect():
        n[r.page_id] = n.get(r.page_id, 0) + 1
        want.add((r.page_id, n[r.page_id], r.attrs["href"]))
    assert {x for x in want if x[2]} == {x for x in got if x[2]}
    assert [r.text for r in page_links.links(pages.filter("page_id = -1")).orderBy("pos").collect()][:3] == ["one", "two bold", "three four"]


def test_japanese_transcripts(spark):
    rows = spark.createDataFrame([("田中：こんにちは\n【司会】はい [拍手]",), ("なし",)], "t string")
    got = rows.select(tr.speaker_labels(F.col("t"), "ja").alias("n"), tr.sound_status(F.col("t"), "ja").alias("s")).collect()
    assert [(r.n > 0, r.s) for r in got] == [(True, "PASSED"), (False, "FAILED")]


def test_snapshot_buckets(spark):
    raw = spark.createDataFrame([("forms", "p", '{"name": "a"}'), ("media", "p", '{"src": "b"}'), ("other", "p", "{}"), ("forms", "p", "{")], "bucket string, page_url string, body string")
    got, bad = sinks.normalize_snapshot(raw, {"forms": "name string", "media": "src string"}, "http://d/")
    assert got["forms"].first().name == "a" and got["media"].first().src == "b"
    assert {r.code for r in bad.collect()} == {"unknown_bucket", "normalization_error"}


def test_parser_holds_few_elements_at_once():
    import tracemalloc

    import pyarrow as pa

    from claraudit.sources import html

    def parsed(texts):
        batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(texts))), "html": texts})
        tracemalloc.start()
        rows = [(b.num_rows, b.nbytes) for b in html._parse(iter([batch]))]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sum(n for n, _ in rows), max(n for n, _ in rows), max(size for _, size in rows), top

    page = "<ul>" + "<li class='a'>x</li>" * 50 + "</ul>"
    few, many = parsed([page] * 200), parsed([page] * 2000)
    assert few[0] == 200 * 51 and many[0] == 2000 * 51 and many[3] < 1.5 * few[3]
    assert many[1] <= html.ROWS_MADE
    whole, _, most, _ = parsed(["<script>" + "x" * (1 << 20) + "</script>"] * 40)
    assert whole == 40 and most < 2 * html.CHARS_MADE
    own, most, _, _ = parsed(["<p>" + "<b>y</b>" * 10_000 + "</p>"])
    assert own == 10_001 and most <= html.ROWS_MADE


def test_sheets_and_scripts_hold_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    from claraudit.sources import css, scripts

    def top(step, extra, text, n):
        batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "pos": pa.array([0] * n, pa.int32()), **{k: [v] * n for k, v in extra.items()}, "text": [text] * n, **({"inline": [False] * n} if extra else {})})
        tracemalloc.start()
        rows = sum(b.num_rows for b in step(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most

    for step, extra, text in ((css._rules(css.VIEWPORT), {"media": ""}, f"/*{'x' * 8000}*/ p {{ top: 0 }}"), (scripts._listeners, {}, f"/*{'x' * 8000}*/ document.onkeydown = go")):
        top(step, extra, text, 10)  # fills caches
        assert top(step, extra, text, 1000) < 1.5 * top(step, extra, text, 100)


@pytest.mark.parametrize("name", "ext_described_by ext_accessible_name join_frame_refs ext_consent_filter ext_media_tracks ext_forms ext_moving ext_visible_label".split())
def test_pages_are_parsed_once(spark, capsys, name):
    from claraudit.plans.catalog import all_queries
    from tests.conftest import DATA

    asked = all_queries()[name](spark, DATA)
    capsys.readouterr()
    asked.explain()
    assert capsys.readouterr().out.count("MapInArrow") <= 1


@pytest.mark.parametrize("name", "ext_relationships ext_elements ext_media ext_moving ext_sensory".split())
def test_pages_of_queries_are_handed_on_in_parts(spark, monkeypatch, capsys, name):
    import tracemalloc

    import pyarrow as pa

    from claraudit.plans.catalog import all_queries
    from claraudit.sources import html
    from tests.conftest import DATA

    given, elements = [], html.elements
    monkeypatch.setattr(html, "elements", lambda pages: given.append(pages) or elements(pages))
    asked = all_queries()[name](spark, DATA)
    assert len(given) == 1
    capsys.readouterr()
    asked.explain()
    # where elements are kept, Python ran once and doesn't run again
    assert capsys.readouterr().out.count("MapInArrow") == (name not in ("ext_relationships", "ext_media"))
    pages = given[0].select("page_id", "html").limit(100).toArrow().combine_chunks().to_batches()[0]

    def parsed(times):
        batch = pa.Table.from_batches([pages] * times).combine_chunks().to_batches()[0]
        tracemalloc.start()
        made = [b.num_rows for b in html._parse(iter([batch]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sum(made), max(made), most

    few, many = parsed(4), parsed(20)
    assert many[0] == 5 * few[0] and many[1] <= 4096 and many[2] < 1.5 * few[2]


def test_accessible_names(spark):
    from claraudit.sources import html

    long = "w " * 400 + "end"
    page = f"""<label>Mail <select><option>1<option>2</select> to <input id=a title=T> me</label><input id=b type=SUBMIT title=T><input id=c type=reset value=' '><input id=d type=button title=T><input id=e type=image title=T>
      <label for=f>First</label><label for=f>Second</label><input id=f><button id=g title=T>Go</button><button id=h>{long}</button><span id=i role=tab>Tab</span><label>Q <button id=j>x</button></label><label for=k></label><input id=k title=T>
      <section id=s>{long}</section><input id=l aria-labelledby='none s e'>"""
    rows = html.interactive(html.elements(spark.createDataFrame([(1, page)], "page_id long, html string"))).collect()
    names = {r.id: r.accessible_name for r in rows if r.id}
    assert names == {"a": "Mail to me", "b": "Submit", "c": "Reset", "d": None, "e": None, "f": "First", "g": "T", "h": long, "i": "Tab", "j": "Q", "k": None, "l": long}


def _with_pages(spark, tmp_path, *bodies):
    spark.createDataFrame([(i, f"http://h{i}/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_descriptions_of_any_element_are_read_whole(spark, tmp_path):
    from claraudit.plans.catalog import all_queries

    long = "w " * 400 + "end"
    at = _with_pages(spark, tmp_path, f"<section id=s>{long}</section><i id=e></i><b id=s>later</b><div aria-describedby='e s'>x</div><a aria-describedby='t'>y</a><em id=t>told</em>")
    got = [r.described_by for r in all_queries()["ext_described_by"](spark, at).collect()]
    assert sorted(got) == sorted([long, "told", "x0 bad"])


def test_references_of_any_element_are_resolved(spark, tmp_path):
    from claraudit.plans.catalog import all_queries

    at = _with_pages(spark, tmp_path, "<div aria-labelledby='h i'>x</div><h2 id=h>Head</h2><p id=i>of it</p>")
    assert sorted(r.ref_text for r in all_queries()["join_frame_refs"](spark, at).collect()) == ["Head of it", "x0 bad"]


def test_sensory_elements(spark):
    from claraudit.sources import html

    long = "w " * 400 + "end"
    page = f"""<html lang=en><body><h2>Head <a title=t>x</a></h2><ul lang=ja><li id=1>Click the round <a id=2>one</a></li></ul><p id=3>ab</p><p id=4>右</p><h3>Next</h3>
      <div id=5>or <p id=6>inner</p></div><div id=7>texts <p>inner</p></div><div><div id=8><b>{long}</b></div></div><input id=9 placeholder='Type the red' value=' '><input id=10 type=checkbox><img title=no>
      <select id=11><option id=12>one<option id=13 value=2 selected>two</select><select id=14><option disabled>none<optgroup><option>free</optgroup></select><textarea id=15>note</textarea><p hidden id=16>hidden</p><span id=17 aria-label=go></span>
      <select multiple id=18><option>one</select></body></html><p id=19>after</p><section id=20>no bearer</section>"""
    els = html.elements(spark.createDataFrame([(1, page)], "page_id long, html string")).withColumn("id", html.attr("id"))
    ids = {r.pos: r.id for r in els.collect()}
    got = {ids[r.pos]: r for r in html.sensory(els).collect() if ids[r.pos]}
    assert set(got) == {str(i) for i in range(1, 20) if i not in (3, 5, 16)}
    assert got["8"].text == long and got["1"].text == "Click the round one" and got["9"].placeholder == "Type the red" and got["9"].value is None
    assert {i: got[i].value for i in ("10", "11", "12", "13", "14", "15", "18", "1")} == {"10": "on", "11": "2", "12": "one", "13": "2", "14": "free", "15": "note", "18": None, "1": None}
    assert {i: got[i].lang for i in ("1", "2", "4", "19")} == {"1": "ja", "2": "ja", "4": "en", "19": "en"}
    assert {i: got[i].nearest_heading for i in ("1", "2", "4", "7", "6", "19")} == {"1": None, "2": None, "4": "Head x", "7": "Next", "6": None, "19": None}
    before = "<p id=a>first</p><div><p id=b>inside</p></div><h1>Late <span id=c>part</span></h1>"
    rows = html.sensory(html.elements(spark.createDataFrame([(1, before)], "page_id long, html string"))).collect()
    assert [(r.tag, r.nearest_heading) for r in sorted(rows, key=lambda r: r.pos)] == [("p", "Late part"), ("p", None), ("h1", None), ("span", "Late part")]
