"""Style sheets, structural joins and checks over them, held against hand-made cases and walks in Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claraudit.operators import layout, page_links, relations, structure
from claraudit.sources import css, html


def _pages(spark, *bodies, url="http://h.example/x"):
    return spark.createDataFrame([(i, url, b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def _styles(spark, page):
    styled, _ = css.read(_pages(spark, page))
    return {r.attrs.get("id"): r.css for r in styled.collect() if r.attrs.get("id")}


def test_sheet_parser():
    sheet = css.parse_sheet("""@import url("x;y"); /* a { b: c } */ a, b:hover > i { color: red; background: url("}{;") } @media print { p { top: 0 } }
      @media (min-width: 10px) and (orientation: landscape), print { @supports (x: y) { .a\\:b [c="]d" i] { order: 1 !important } } }
      @keyframes k { from { top: 0 } } u { unclosed: yes""")
    assert [(r["selector"], len(r["media"]), r["applies"]) for r in sheet] == [("a", 0, True), ("b:hover > i", 0, True), ("p", 1, False), ('.a\\:b [c="]d" i]', 2, True)]
    assert sheet[0]["declared"] == [{"property": "color", "value": "red", "important": False}, {"property": "background", "value": 'url("}{;")', "important": False}]
    assert sheet[1]["steps"] is None and sheet[3]["declared"][0]["important"]
    steps, weight = css.steps_of("#a.b > c[d] ~ *")
    assert [(s["comb"], s["key"]) for s in steps] == [("", "#a"), (">", "c"), ("~", "*")] and weight == (1 << 20) + (2 << 10) + 1
    assert css.steps_of("a >") is None and css.steps_of("a::before") is None and css.steps_of("") is None
    assert dict(css._longhands("animation", "3s ease-in 1s infinite slide, 800ms fade paused")) == {"animation-name": "slide, fade", "animation-duration": "3s, 800ms", "animation-iteration-count": "infinite, 1", "animation-play-state": "running, paused"}


@pytest.mark.parametrize(("query", "holds"), [("screen", True), ("print", False), ("not all", False), ("(min-width: 1280px)", True), ("(max-width: 1279.5px)", False), ("(orientation: portrait)", False), ("screen and (orientation: landscape) and (min-height: 700px)", True), ("(hover: hover)", False), ("print, (width: 1280px)", True)])
def test_media_queries(query, holds):
    assert css.media_holds(query, 1280, 720) is holds


def test_cascade(spark):
    got = _styles(spark, """<html><style>p { a: tag; b: tag; c: tag !important; d: 1 } .x { a: class; b: class } #one { a: id } p { d: 2 } div > .y + p { e: next } section .y ~ p { f: later } [data-q~=r] { g: word } li:first-child { h: first } li:last-child { h: last } :root { i: root }</style>
      <section id="s"><div><i class="y"></i><p id="one" class="x" style="b: inline; c: inline" data-q="q r"><p id="two" data-q="qr"></p></div></section><ul><li id="l1"><li id="l2"><li id="l3"></ul><p id="three" class="x">""")
    assert got["one"] == {"a": "id", "b": "inline", "c": "tag", "d": "2", "e": "next", "f": "later", "g": "word"}
    assert got["two"] == {"a": "tag", "b": "tag", "c": "tag", "d": "2", "f": "later"}
    assert got["three"]["a"] == "class" and "f" not in got["three"]
    assert [got[x].get("h") for x in ("l1", "l2", "l3")] == ["first", None, "last"]


def test_selectors_however_deep(spark):
    got = _styles(spark, "<style>#far .mid b { a: 1 } #far > b { a: 2 }</style><div id=far>" + "<div>" * 500 + "<p class=mid>" + "<i>" * 500 + "<b id=deep>x</b></p></div><b id=out>")
    assert got["deep"] == {"a": "1"} and got["out"] == {}


def test_structural_joins_equal_walks(spark):
    rng = random.Random(7)
    bodies = []
    for _ in range(6):
        parts, opened = [], []
        for _ in range(120):
            if opened and rng.random() < 0.45:
                parts.append(f"</{opened.pop()}>")
            else:
                opened.append(rng.choice(["div", "span", "section", "b"]))
                parts.append(f'<{opened[-1]} class="{rng.choice(["k", "k", "o", "p"])}">')
        bodies.append("".join(parts))
    els = html.elements(_pages(spark, *bodies, "<div class=k>" * 1000 + "<b class=o>x"))
    of = html.attr("class") == "k"
    rows = structure.nearest(els.withColumn("within", structure.inside(of, "page_id")), of, "near").collect()
    assert len(rows) == els.count()
    pages = {}
    for r in rows:
        pages.setdefault(r.page_id, []).append(r)
    for own in pages.values():
        for y in own:
            around = [x.pos for x in own if x.attrs["class"] == "k" and x.pos < y.pos <= x.last]
            assert (y.near, y.within) == (max(around, default=None), bool(around))


def test_meaningful_sequence(spark):
    page = """<style>.f { display: flex } .g { display: inline-grid } .r { flex-direction: row-reverse }</style>
      <div class="f" id="same"><p style="order: 1">a<p style="order: 1">b</div><div class="f"><p style="order: 2">a<p style="order: 1">b</div><div class="f r"><p>a<p>b</div>
      <div class="f r"><button>a</button><a>b</a></div><div class="g"><p style="grid-row: 2">a<p>b</div><div class="f"><p style="float: right">a<p>b</div><div class="f r"><p>a<p style="visibility: hidden">b</div>"""
    found = layout.reordered(css.read(_pages(spark, page, '<html dir="RTL">' + page, '<html lang="he-IL">' + page, "<p>nothing"))[0])
    codes = [r.code for r in found.filter("page_id = 0").orderBy("pos").collect()]
    assert codes == ["css-order-reorders", "flex-direction-reverse", "grid-explicit-placement", "mixed-floats"]
    assert [found.filter(F.col("page_id") == p).count() for p in (1, 2, 3)] == [3, 3, 0]
    status = {r.page_id: r.status for r in layout.meaningful_sequence(_pages(spark, page, page, page, ""), found).collect()}
    assert status == {0: "incomplete", 1: "incomplete", 2: "incomplete", 3: "pass"}
    assert layout.reordered(css.read(_pages(spark, page))[0], most=2).count() == 1


def test_orientation(spark):
    page = """<html><head><meta name=viewport content="orientation=portrait, maximum-scale=1.0"><link rel="icon stylesheet" href="//cdn.example/a.css"><link rel=stylesheet href=/own.css>
      <style>@media screen and (orientation:landscape) { a, b { height: 0px } } @media (orientation: portrait) { @media (orientation: landscape) { c { display: none } } } @media (min-width: 9px) { @media (orientation: portrait) { d { width: 10vh } } }
      html { writing-mode: vertical-lr } #app-root { transform: matrix(0, 1, -1, 0, 0, 0) } .x { rotate: 270deg }</style></head>
      <body><script>screen.msLockOrientation ( 'a' )</script><div id="app-root">a</div><div class="x">b</div><div class="wrapper x">c</div><nav style="transform: rotate(45deg)">d</nav></body>"""
    pages = _pages(spark, page, "<p>clean")
    styled, sheet = css.read(pages)
    got = {(r.kind, r.target, r.status) for r in layout.orientation(styled, sheet, pages).filter("page_id = 0").collect()}
    assert got == {("script-lock", "inline <script> #1", "fail"), ("css-rotate", "div#app-root", "incomplete"), ("css-rotate", "div.wrapper.x", "incomplete"), ("css-media-hide", "a, b", "incomplete"), ("css-media-structural", "a, b", "incomplete"), ("css-media-structural", "d", "incomplete"), ("cross-origin-sheet", "http://cdn.example/a.css", "incomplete"), ("meta-viewport-orientation", "meta[name=viewport]", "fail"), ("viewport-scale", "meta[name=viewport]", "incomplete"), ("writing-mode", "body", "fail")}
    assert layout.orientation(styled, sheet, pages).filter("page_id = 1").count() == 0


def test_animations(spark):
    page = """<style>.a { animation: 2s infinite x } .b { animation: y 6s; animation-play-state: paused } .c { animation: z 2s 2 } .d { animation-name: u, v, w; animation-duration: 3s, 6s; animation-iteration-count: 2 }</style>
      <section><div><i class="a" id="i">x</i></div><a title="Stop it"></a></section><div aria-busy="true"><p><b class="b">y</b></p></div><b class="c">z</b><u class="d">u</u><div hidden><i class="a">h</i></div>"""
    got = {(r.tag, r.animation_name, r.duration_seconds, r.has_pause_button, r.has_mechanism, r.exception) for r in layout.animations(css.read(_pages(spark, page))[0]).collect()}
    assert got == {("i", "x", -1.0, True, True, None), ("b", "y", 6.0, False, True, "loading_indicator"), ("u", "u", 6.0, False, False, None), ("u", "v", 12.0, False, False, None), ("u", "w", 6.0, False, False, None)}


def test_relationships(spark):
    deep = "<div>" * 300
    page = f"""<fieldset><legend>Outer</legend><fieldset>{deep}<input id="a" aria-label="A">{"</div>" * 300}</fieldset></fieldset><fieldset><p><legend>Late</legend><select id="b" title="B"></select></fieldset>
      <table role="presentation"><tr><td><input id="c"></td></tr></table><table><tr><td><span role="button"><img id="d"></span></td></tr></table><label for="c">See</label><div data-video-id="1"><i id="e"></i></div>"""
    got = {r.id: r for r in relations.relationships(html.elements(_pages(spark, page)), html.attr("id").isNotNull()).collect()}
    assert {k: (r.group_name, r.accessible_name) for k, r in got.items()} == {"a": ("Outer", "Outer: A"), "b": ("Late", "Late: B"), "c": (None, "See"), "d": (None, None), "e": (None, None)}
    assert {k for k, r in got.items() if r.in_data_table} == {"d"} and {k for k, r in got.items() if r.in_video} == {"e"}
    assert not got["d"].in_labeled_control and got["c"].native_label == "See"


def test_links_of_odd_markup(spark):
    page = """<!-- <a href="/comment">c</a> --><script>var x = '<a href="/script">s</a>'</script><a title="a > b" href='/real'>real <b>one</b><a class=x HREF=/next>next</a> tail<abbr href="/no">no</abbr><a name=n>n</a><a href>empty</a>"""
    rows = page_links.links(_pages(spark, page)).orderBy("pos").collect()
    assert [(r.pos, r.href, r.text) for r in rows] == [(1, "/real", "real one"), (2, "/next", "next"), (3, "", "empty")]
    parsed = html.elements(_pages(spark, page)).filter("tag = 'a' and attrs['href'] is not null").orderBy("pos").collect()
    assert [r.attrs["href"] for r in parsed] == [r.href for r in rows]


def test_reader_takes_linear_time_behind_buttons():
    def took(n):
        r, at = html._Reader(), time.perf_counter()
        r.feed("<p><button>" + "<span>" * n + "<p>" * n)
        r.done()
        return time.perf_counter() - at

    took(500)
    assert took(16000) < 40 * max(took(2000), 0.005)


def test_help_over_sites(spark):
    call, faq, chat = '<header><a href="tel:1">Call</a></header>', "<footer><a href=/q>Support</a></footer>", '<div class="chat">c</div>'
    bodies = [call + faq] * 5 + [faq + call, call + "<nav><a href=/q>Support</a></nav>", chat, "<p>none"]
    pages = _pages(spark, *bodies)
    got = {r.page_id: (r.kinds, r.departs, r.status) for r in relations.consistent_help(pages, relations.help_mechanisms(html.elements(pages)), F.lit("s")).collect()}
    assert got[0] == ("phone,link", "", "pass") and got[5] == ("link,phone", "order:link-phone", "fail") and got[6] == ("phone,link", "place:link", "fail")
    assert got[7] == ("widget", "", "pass") and got[8] == ("", "", "incomplete")


def test_targets_from_styles(spark):
    page = """<style>.big { min-width: 30px; min-height: 2rem } .side { padding: 12px 13px 12px } .line { width: 90px; height: 90px }</style>
      <button id="b0" style="width: 10px; max-width: 4px">x</button><button id="b1" class="big">x</button><button id="b2" style="width: 50%; height: 30px">x</button>
      <p>in <a id="a0" href="/" class="line">a</a> text <a id="a1" href="/" style="display: inline-block; width: 8px">b</a></p><p><a id="a2" href="/" class="side">c</a></p><p><a id="a3" class="line">no target</a></p>
      <div role="LINK" id="r0" style="width: 20px; height: 23px; border: 2px solid">r</div><div style="display: none"><i><b role="tab" id="gone" style="width: 1px">r</b></i></div><input type="radio" id="k0"><input type="text" id="no" style="width: 3px">"""
    styled, _ = css.read(_pages(spark, page, "", None))
    found = layout.targets(styled).join(styled.select("page_id", "pos", html.attr("id").alias("id")), ["page_id", "pos"])
    got = {r.id: (r.rendered_width_px, r.least_width_px, r.status, r.reason) for r in found.collect()}
    assert got == {
        "b0": (4.0, 4.0, "NEEDS_REVIEW", "small"), "b1": (None, 30.0, "PASSED", "size"), "b2": (None, 0.0, None, None),
        "a0": (None, 0.0, "N/A", "inline"), "a1": (8.0, 8.0, "NEEDS_REVIEW", "small"), "a2": (None, 26.0, "PASSED", "size"),
        "r0": (24.0, 24.0, "PASSED", "size"), "k0": (None, 0.0, "N/A", "user_agent"),
    }
    assert dict(css._longhands("padding", "1px 2px 3px")) == {"padding-top": "1px", "padding-right": "2px", "padding-bottom": "3px", "padding-left": "2px"}
    assert dict(css._longhands("padding", "1px 2px 3px 4px"))["padding-left"] == "4px" and dict(css._longhands("padding", "1px 2px"))["padding-left"] == "2px"


def test_texts_of_pages_with_language(spark):
    from claraudit.operators import sensory
    from claraudit.plans.extract import page_tables

    page = """<html lang="en"><body><p>Click the round icon.</p><div lang="ja-JP"><div><p>Tap 右</p></div></div><p lang="">Tap 右</p><p title="Press the red button" aria-label="ok">Plain words here</p></body></html>"""
    rows = page_tables(_pages(spark, page, "", None))["text_block"]
    assert {(r.text, r.lang) for r in rows.collect()} == {("Click the round icon.", "en"), ("Tap 右", "ja-JP"), ("Tap 右", "en"), ("Plain words here", "en")}
    got = {(r.sentence, r.categories, r.status) for r in sensory.findings(rows).collect()}
    assert got == {("Click the round icon.", "shape", "FAILED"), ("Press the red button", "color", "FAILED")}
