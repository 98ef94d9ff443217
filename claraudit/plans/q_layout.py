"""Queries over styled elements of `pages` and over what stands around them. Each page gets markup appended whose values are
arithmetic of its number, so SQL can say by the same arithmetic what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.functions import urls
from claraudit.operators import layout, relations
from claraudit.plans.registry import Registry, appended
from claraudit.sources import css, html
from claraudit.sources.stage import kept

query = Registry()
QUERIES, SQL = query.queries, query.sql


_ORDER = (
    "<style>.fx { display: flex } #o{{page_id % 3}} > .late { order: 7 } .grid { display: grid } @media (max-width: 9px) { div { display: flex; flex-flow: row-reverse } }</style>",
    '<div id="o1" class="fx"><i style="order: {{page_id % 11}}">a</i><i style="order: {{page_id % 13}}">b</i><i class="late">c</i></div>',
    ("page_id % 2 = 0", "{{repeat('<div class=\"fx\" style=\"flex-direction: row-reverse\"><p>a</p><p>b</p></div>', cast(page_id % 5 as int))}}"),
    ("page_id % 7 = 1", '<div class="grid"><p style="grid-area: 2 / {{page_id % 4 + 1}}">a</p><p>b</p></div>'),
    ("page_id % 7 = 2", '<div class="fx"><p style="float: left">a</p><p>b</p></div>'),
    ("page_id % 7 = 3", '<section dir="rtl"><p><span class="fx" style="flex-flow: row-reverse"><b>a</b><b>b</b></span></section><div class="fx" style="flex-direction: column-reverse"><button>a</button><span role="tab">b</span></div>'),
    ("page_id % 7 = 4", '<div class="fx" style="flex-direction: row-reverse"><p>a</p><p style="display: none">b</p></div>'),
)


@query("chk_meaningful_sequence", """
WITH x AS (SELECT page_id, page_id % 11 > page_id % 13 OR page_id % 13 > CASE WHEN page_id % 3 = 1 THEN 7 ELSE 0 END AS ord, CASE WHEN page_id % 2 = 0 THEN page_id % 5 ELSE 0 END AS rev FROM pages),
y AS (SELECT page_id, CAST(ord AS BIGINT) + rev + CAST(page_id % 7 IN (1, 2) AS BIGINT) AS n, concat_ws(',', CASE WHEN ord THEN 'css-order-reorders' END, CASE WHEN rev > 0 THEN 'flex-direction-reverse' END, CASE page_id % 7 WHEN 1 THEN 'grid-explicit-placement' WHEN 2 THEN 'mixed-floats' END) AS codes FROM x)
SELECT page_id, n, codes, CASE WHEN n > 0 THEN 'incomplete' ELSE 'pass' END AS status FROM y""")
def chk_meaningful_sequence(spark, sf_dir):
    pages = appended(spark, sf_dir, *_ORDER)
    return layout.meaningful_sequence(pages, layout.reordered(css.read(pages)[0]))


_TURN = (
    "<style>@media (orientation: portrait) { .m{{page_id % 9}} { display: none } .x, .y { position: fixed } @supports (a: b) { .z { display: none } } } @media print { .w { display: none } } .turn { transform: rotate({{45 * (page_id % 9)}}deg) } body { writing-mode: {{if(page_id % 5 = 0, 'vertical-rl', 'horizontal-tb')}} }</style>",
    '<main class="turn r{{page_id % 4}}">m</main><div class="turn">d</div><section style="transform: rotate({{if(page_id % 6 = 0, 0.5, 0.2)}}turn)">s</section>',
    ("page_id % 3 = 0", "<script>if (x) screen . orientation.lock('a'); screen.lockOrientation('b'); screen.orientation.lock('c')</script><script src='x.js'>screen.orientation.lock('d')</script>"),
    '<meta name="viewport" content="width=device-width, maximum-scale={{page_id % 4}}{{if(page_id % 8 = 2, \', orientation=portrait\', \'\')}}">',
    '<link rel="stylesheet" href="{{if(page_id % 2 = 0, \'https://cdn.example/{{x.css\', \'/own.css\')}}">'.replace("{{x", "x"),
)


@query("chk_orientation", """
SELECT page_id, kind, target, detail, CASE WHEN kind IN ('script-lock', 'meta-viewport-orientation', 'manifest-orientation', 'writing-mode') THEN 'fail' ELSE 'incomplete' END AS status FROM (
  SELECT page_id, 'css-media-hide' AS kind, '.m' || (page_id % 9) AS target, '(orientation: portrait)' AS detail FROM pages
  UNION ALL SELECT page_id, 'css-media-structural', '.x, .y', '(orientation: portrait)' FROM pages
  UNION ALL SELECT page_id, 'css-rotate', 'main.turn.r' || (page_id % 4), 'transform ' || CASE page_id % 9 WHEN 2 THEN '90' ELSE '-90' END FROM pages WHERE page_id % 9 IN (2, 6)
  UNION ALL SELECT page_id, 'css-rotate', 'section', 'inline transform' FROM pages WHERE page_id % 6 = 0
  UNION ALL SELECT page_id, 'script-lock', 'inline <script> #' || (len(regexp_extract_all(html, '<script>')) + 1), 'screen.orientation.lock(, screen.lockOrientation(' FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'viewport-scale', 'meta[name=viewport]', 'width=device-width, maximum-scale=1' FROM pages WHERE page_id % 4 = 1
  UNION ALL SELECT page_id, 'meta-viewport-orientation', 'meta[name=viewport]', 'width=device-width, maximum-scale=2, orientation=portrait' FROM pages WHERE page_id % 8 = 2
  UNION ALL SELECT page_id, 'cross-origin-sheet', 'https://cdn.example/x.css', '' FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 'writing-mode', 'body', 'vertical-rl' FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 'manifest-orientation', 'manifest.json', 'Landscape' FROM pages WHERE page_id % 10 = 3)""")
def chk_orientation(spark, sf_dir):
    pages = appended(spark, sf_dir, *_TURN)
    manifests = pages.select("page_id", F.when(F.col("page_id") % 10 == 3, '{"name": "n", "orientation": "Landscape"}').when(F.col("page_id") % 10 == 4, '{"orientation": {"a": 1}}').otherwise("{").alias("body"))
    styled, sheet = css.read(pages)
    return layout.orientation(styled, sheet, pages, manifests)


_MOVE = (
    "<style>.spin { animation: {{page_id % 8}}s linear turn } .two { animation-name: a, b; animation-duration: 800ms, 2s; animation-iteration-count: {{page_id % 9}}, infinite } @keyframes turn { from { top: 0 } }</style>",
    '<div><div><div class="spin">x</div></div></div><section>{{repeat(\'<div>\', cast(page_id % 4 as int))}}<p class="two">y</p>{{repeat(\'</div>\', cast(page_id % 4 as int))}}<button title="Pause">{{if(page_id % 3 = 0, \'\', \'Play\')}}</button></section>',
    ("page_id % 2 = 0", '<div><div class="page-loading">{{repeat(\'<div>\', cast(page_id % 10 as int))}}<i style="animation: pulse 9s; animation-play-state: paused">z</i></div></div>'),
)


@query("ext_moving_css", """
WITH x AS (
  SELECT page_id, 'div' AS tag, 'turn' AS animation_name, CAST(page_id % 8 AS DOUBLE) AS duration_seconds, false AS pause, false AS mechanism, '' AS exception FROM pages WHERE page_id % 8 > 5
  UNION ALL SELECT page_id, 'p', 'a', 0.8 * (page_id % 9), page_id % 4 < 2 AND page_id % 3 = 0, page_id % 4 < 2 AND page_id % 3 = 0, '' FROM pages WHERE 0.8 * (page_id % 9) > 5
  UNION ALL SELECT page_id, 'p', 'b', -1.0, page_id % 4 < 2 AND page_id % 3 = 0, page_id % 4 < 2 AND page_id % 3 = 0, '' FROM pages
  UNION ALL SELECT page_id, 'i', 'pulse', 9.0, false, true, CASE WHEN page_id % 10 < 7 THEN 'loading_indicator' ELSE '' END FROM pages WHERE page_id % 2 = 0)
SELECT page_id, tag, animation_name, round(CAST(duration_seconds AS DOUBLE), 3) AS duration_seconds, pause AS has_pause_button, mechanism AS has_mechanism, exception FROM x""")
def ext_moving_css(spark, sf_dir):
    found = layout.animations(css.read(appended(spark, sf_dir, *_MOVE))[0])
    return found.select("page_id", "tag", "animation_name", F.round("duration_seconds", 3).alias("duration_seconds"), "has_pause_button", "has_mechanism", F.coalesce("exception", F.lit("")).alias("exception"))


_TARGETS = (
    "<style>.t { padding: {{page_id % 9}}px {{page_id % 7}}px } .w { width: {{page_id % 40}}px; height: 30px } .none { display: none } .c { box-sizing: border-box; width: 1.5rem; height: 20px; min-height: {{page_id % 30}}px } .auto { appearance: none }</style>",
    '<section><button id="b" class="t w">b</button><div id="d" role="tab" class="t w">d</div><p>See <a id="i" href="/i" class="w">this</a> now</p><p><a id="l" href="/l" class="t">alone</a></p>',
    '<div><span id="s" role="Button" class="c">s</span><input id="k" type="checkbox" class="{{if(page_id % 2 = 0, \'auto c\', \'c\')}}"><input id="g" type="image" width="{{page_id % 50}}" height="24"></div>',
    '<div class="{{if(page_id % 3 = 0, \'none\', \'some\')}}">{{repeat(\'<div>\', cast(page_id % 40 as int))}}<button id="n" style="width: 10px">n</button></section>',
)


@query("ext_targets_page", """
WITH r AS (
  SELECT page_id, 'b' AS id, greatest(page_id % 40, 2 * (page_id % 7)) AS w, 30 AS h, NULL AS exception FROM pages
  UNION ALL SELECT page_id, 'd', page_id % 40 + 2 * (page_id % 7), 30 + 2 * (page_id % 9), NULL FROM pages
  UNION ALL SELECT page_id, 'i', NULL, NULL, 'inline' FROM pages UNION ALL SELECT page_id, 'l', NULL, NULL, NULL FROM pages
  UNION ALL SELECT page_id, 's', NULL, NULL, NULL FROM pages
  UNION ALL SELECT page_id, 'k', 24, greatest(20, page_id % 30), CASE WHEN page_id % 2 = 1 THEN 'user_agent' END FROM pages
  UNION ALL SELECT page_id, 'g', page_id % 50, 24, NULL FROM pages
  UNION ALL SELECT page_id, 'n', 10, NULL, NULL FROM pages WHERE page_id % 3 <> 0)
SELECT page_id, id, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, coalesce(CASE WHEN exception IS NOT NULL THEN exception WHEN w >= 24 AND h >= 24 THEN 'size' WHEN w < 24 OR h < 24 THEN 'small' END, '') AS reason FROM r""")
def ext_targets_page(spark, sf_dir):
    styled, _ = css.read(appended(spark, sf_dir, *_TARGETS))
    named = styled.filter(html.attr("id").isin("b", "d", "i", "l", "s", "k", "g", "n")).select("page_id", "pos", html.attr("id").alias("id"))
    found = layout.targets(styled).join(named, ["page_id", "pos"])
    return found.select("page_id", "id", F.col("rendered_width_px").alias("w"), F.col("rendered_height_px").alias("h"), F.coalesce("reason", F.lit("")).alias("reason"))


_DEEP = "{{repeat('<div>', cast(page_id % 40 as int))}}"
_RELATED = (
    f"<fieldset><legend>Group {{{{page_id % 6}}}}</legend>{_DEEP}{{{{if(page_id % 3 = 0, '<table><tr><td>', if(page_id % 3 = 1, '<table role=\"presentation\"><tr><td>', '<fieldset>'))}}}}",
    '<input id="in" aria-label="Name {{page_id % 5}}" aria-describedby="d1 dx d2"></fieldset></fieldset></div></div>',
    '<p id="d1">one {{page_id % 5}}</p><p id="d2">two</p><a href="#top"><b><i><img id="im" alt="x"></i></b>{{if(page_id % 2 = 0, \' go\', \'\')}}</a>',
    ("page_id % 4 = 0", '<div class="Big-Player"><span><label>Volume {{page_id % 9}}{{repeat(\'<b>\', 12)}}<input id="vol" type="range"></label></span></div>'),
)


@query("ext_relationships", """
SELECT page_id, 'in' AS id, 'one ' || (page_id % 5) || ' | two' AS described_by, 'Group ' || (page_id % 6) || ': Name ' || (page_id % 5) AS name, '' AS label, page_id % 3 = 0 AS in_data_table, false AS in_labeled_control, false AS in_video FROM pages
UNION ALL SELECT page_id, 'im', '', '', '', false, page_id % 2 = 0, false FROM pages
UNION ALL SELECT page_id, 'vol', '', 'Volume ' || (page_id % 9), 'Volume ' || (page_id % 9), false, false, true FROM pages WHERE page_id % 4 = 0""")
def ext_relationships(spark, sf_dir):
    els = kept(html.elements(appended(spark, sf_dir, *_RELATED)), "elements")
    found = relations.relationships(els, F.coalesce(html.attr("id").isin("in", "im", "vol"), F.lit(False)))
    blank = lambda c, to: F.coalesce(c, F.lit("")).alias(to)
    return found.select("page_id", "id", blank("described_by", "described_by"), blank("accessible_name", "name"), blank("native_label", "label"), "in_data_table", "in_labeled_control", "in_video")


_MEDIA = (
    '<section><h2>h</h2><a href="/far">no</a><article><details><summary>more {{page_id % 6}}</summary></details><div><p>words {{page_id % 9}}</p> ',
    '{{repeat(\'<div>\', cast(page_id % 5 as int))}}<video src="v{{page_id % 3}}.mp4" muted><track kind="captions" src="c.vtt"></video>{{repeat(\'</div>\', cast(page_id % 5 as int))}}<a href="/t{{page_id % 4}}">Transcript</a></div></article></section>',
)


@query("ext_media", """SELECT page_id, 'v' || (page_id % 3) || '.mp4' AS src, 'captions' AS track_kinds,
  CASE WHEN page_id % 5 = 0 THEN '/far,' ELSE '' END || CASE WHEN page_id % 5 <= 2 THEN '/t' || (page_id % 4) ELSE '' END AS links,
  CASE WHEN page_id % 5 < 2 THEN 'more ' || (page_id % 6) ELSE '' END AS details, CASE WHEN page_id % 5 = 0 THEN 'words ' || (page_id % 9) || ' Transcript' ELSE '' END AS nearby_text FROM pages""")
def ext_media(spark, sf_dir):
    found = relations.media_context(kept(html.elements(appended(spark, sf_dir, *_MEDIA)), "elements"))
    href = F.array_join(F.transform("links", lambda x: F.element_at(F.split(x, " "), -1)), ",")
    # a page's own markup comes first: the fixture's links are those of its two addresses
    return found.select("page_id", "src", F.array_join(F.transform("tracks", lambda t: t["kind"]), ",").alias("track_kinds"), href.alias("links"), F.array_join("details", ",").alias("details"), F.coalesce("nearby_text", F.lit("")).alias("nearby_text"))


_BACK = ("<style>.b3 { background-color: #030303 } .bt { background: transparent } article.b{{page_id % 4}} span { background: rgb(1, 2, {{page_id % 9}}) }</style>", '<article class="b{{page_id % 5}}">{{repeat(\'<div class="bt">\', cast(page_id % 30 as int))}}<span><b id="t">x</b></span></article>')


@query("ext_context", "SELECT page_id, CASE WHEN page_id % 4 = page_id % 5 THEN 'rgb(1, 2, ' || (page_id % 9) || ')' WHEN page_id % 5 = 3 THEN '#030303' ELSE 'rgb(255, 255, 255)' END AS background FROM pages")
def ext_context(spark, sf_dir):
    styled, _ = css.read(appended(spark, sf_dir, *_BACK))
    return relations.backgrounds(styled.withColumn("_t", html.attr("id") == "t").withColumn("tag", F.when(F.col("_t"), "target").otherwise(F.col("tag")))).filter("tag = 'target'").select("page_id", "background")


_CALL, _FAQ = '<header><a href="tel:1">Call</a></header>', '<{{if(page_id % 7 = 0, \'nav\', \'footer\')}}><p><a href="/faq">FAQ</a></p></{{if(page_id % 7 = 0, \'nav\', \'footer\')}}>'
_HELP = (("page_id % 11 <> 0 and page_id % 5 <> 0", _CALL), ("page_id % 11 <> 0", _FAQ), ("page_id % 11 <> 0 and page_id % 5 = 0", _CALL), ("page_id % 6 = 1", '<div id="Chat-box">c</div>'))
_SITE = "lower(regexp_extract(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1), '([^.]+[.][^.]+)$', 1))"


@query("chk_consistent_help_site", f"""
WITH m AS (
  SELECT page_id, {_SITE} AS site, kind, place, pos FROM pages, LATERAL (VALUES
    ('phone', 'header', CASE WHEN page_id % 5 = 0 THEN 3 ELSE 1 END, page_id % 11 <> 0), ('link', CASE WHEN page_id % 7 = 0 THEN 'nav' ELSE 'footer' END, 2, page_id % 11 <> 0), ('widget', 'body', 4, page_id % 6 = 1)) t(kind, place, pos, there) WHERE there),
o AS (SELECT x.page_id, x.site, x.kind AS a, y.kind AS b, x.pos < y.pos AS forward FROM m x JOIN m y ON x.page_id = y.page_id AND x.kind < y.kind),
u AS (SELECT site, a, b, count(*) FILTER (forward) AS f, count(*) AS n FROM o GROUP BY ALL),
p AS (SELECT site, kind, place, count(*) AS n FROM m GROUP BY ALL), q AS (SELECT site, kind, max(n) AS most, sum(n) AS every, arg_max(place, n) AS place FROM p GROUP BY ALL),
d AS (SELECT page_id, 'order:' || o.a || '-' || o.b AS why FROM o JOIN u ON o.site = u.site AND o.a = u.a AND o.b = u.b WHERE CASE WHEN forward THEN f * 2 < n ELSE f * 2 > n END
  UNION ALL SELECT page_id, 'place:' || m.kind FROM m JOIN q ON m.site = q.site AND m.kind = q.kind WHERE most * 2 > every AND m.place <> q.place)
SELECT page_id, {_SITE} AS site, coalesce((SELECT string_agg(kind, ',' ORDER BY pos) FROM m WHERE m.page_id = g.page_id), '') AS kinds, coalesce((SELECT string_agg(why, ',' ORDER BY why) FROM d WHERE d.page_id = g.page_id), '') AS departs,
  CASE WHEN page_id NOT IN (SELECT page_id FROM m) THEN 'incomplete' WHEN page_id IN (SELECT page_id FROM d) THEN 'fail' ELSE 'pass' END AS status FROM pages g""")
def chk_consistent_help_site(spark, sf_dir):
    pages = appended(spark, sf_dir, *_HELP)
    site = F.lower(F.regexp_extract(urls.host(F.col("url")), r"([^.]+[.][^.]+)$", 1))
    return relations.consistent_help(pages, kept(relations.help_mechanisms(html.elements(pages)), "help"), site)
