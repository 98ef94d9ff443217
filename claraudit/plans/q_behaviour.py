"""Queries of behaviour over `pages` with scripts and handlers appended, and the audit over tables made from raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.operators import behaviour
from claraudit.operators.entry_fields import entry_fields
from claraudit.operators.form_checks import redundant_entry
from claraudit.plans.audit import AuditConfig, audit
from claraudit.plans.extract import page_tables
from claraudit.plans.registry import Registry, appended
from claraudit.sources import css, html, scripts
from claraudit.sources.stage import kept

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _behaving(spark, sf_dir, *parts):
    # what these checks read of elements; texts stay behind
    els = html.elements(appended(spark, sf_dir, *parts)).select("page_id", "pos", "tag", "attrs", "last", "ancestors", "content")
    els = kept(css.placed(els).drop("ancestors"), "elements")
    return els, kept(scripts.handlers(els, kept(scripts.listeners(els), "listeners")), "handlers")


_KEYS = (
    "<button id='k' accesskey='{{element_at(array('s', '7', '!', 'Enter', ''), cast(page_id % 5 + 1 as int))}}'>a</button>",
    "<div><input id='i' onkeydown=\"if (event.key === 'x') {{repeat('/*', cast(page_id % 2 as int))}}{{repeat(' ', cast(page_id % 7 * 30 as int))}}if (event.ctrlKey) go()\" onkeyup='go()'></div>",
    ("page_id % 3 = 0", "<script>// document.addEventListener('keydown', e => e.key === 'z')\nvar s = \"document.addEventListener('keydown', e => e.key === 'z')\";</script>"),
    ("page_id % 3 = 1", "<script>const box = document.querySelector('div > #i'); box.addEventListener('keypress', function (e) { if (e.code == 'q') go(); })</script>"),
    ("page_id % 4 = 1", "<script>function f(e) { return e.metaKey && e.keyCode === 70 } document.addEventListener('keyup', f); window.onkeydown = e => { if (e.key.toLowerCase() === 'k') go() }</script>"),
)


@query("chk_char_keys", """
SELECT page_id, 'accesskey' AS kind, CASE page_id % 5 WHEN 0 THEN 's' ELSE '!' END AS detail, 'button' AS tag FROM pages WHERE page_id % 5 IN (0, 2)
UNION ALL SELECT page_id, 'inline-handler', '.key === ''x''', 'input' FROM pages WHERE 24 + 2 * (page_id % 2) + 30 * (page_id % 7) > 120
UNION ALL SELECT page_id, 'script-listener', '.code == ''q''', 'input' FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'script-listener', '.key.toLowerCase() === ''k''', 'document' FROM pages WHERE page_id % 4 = 1""")
def chk_char_keys(spark, sf_dir):
    els, own = _behaving(spark, sf_dir, *_KEYS)
    found = behaviour.character_keys(els, own).join(els.select("page_id", "pos", "tag"), ["page_id", "pos"], "left")
    return found.select("page_id", "kind", "detail", F.coalesce("tag", F.lit("document")).alias("tag"))


_POINT = (
    "<p><b id='one' onmousedown=\"{{element_at(array('save(1)', 'return false', 'this.style', 'look()'), cast(page_id % 4 + 1 as int))}}\" {{if(page_id % 3 = 0, 'onclick=\"x()\"', '')}}>a</b><textarea onpointerdown='submit()'></textarea></p>",
    ("page_id % 2 = 0", "<ul id='list'><li>a<li class='q'>b</ul><script>document.querySelectorAll('#list li').forEach(li => { li.addEventListener('touchstart', send); }); const send = () => fetch('/x');</script>"),
    ("page_id % 4 = 0", "<script>document.querySelector('li.q').ontouchend = () => stop()</script>"),
)


@query("chk_pointer_cancel", """
SELECT page_id, 'b' AS tag, CAST(1 AS BIGINT) AS n FROM pages WHERE page_id % 4 = 0 AND page_id % 3 <> 0
UNION ALL SELECT page_id, 'li', CASE WHEN page_id % 4 = 0 THEN 1 ELSE 2 END FROM pages WHERE page_id % 2 = 0""")
def chk_pointer_cancel(spark, sf_dir):
    els, own = _behaving(spark, sf_dir, *_POINT)
    return behaviour.pointer_cancellation(els, own).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_DRAG = (
    "<div><section>{{if(page_id % 3 = 0, '<button>up</button>', '')}}<i draggable='true'>a</i></section></div>",
    "<div><section><u data-rbd-draggable-id='{{if(page_id % 4 = 0, '', 'r')}}'>b{{if(page_id % 5 = 0, '<a href=\"#\">down</a>', '')}}</u></section></div>",
    ("page_id % 2 = 1", "<div><p class='card'>c</p></div><script>let c = document.getElementsByClassName('card'); for (const x of c) x.y(); document.querySelector('.card').addEventListener('pointerdown', e => { document.onpointermove = m }); document.querySelector('p.card').ontouchmove = m</script>"),
    ("page_id % 6 = 2", "<div><em ondragstart='go()' draggable='false'>d</em></div>"),
)


@query("chk_dragging", """
SELECT page_id, 'native' AS kind, page_id % 3 = 0 AS alternative FROM pages
UNION ALL SELECT page_id, 'library', page_id % 5 = 0 FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 'pointer', false FROM pages WHERE page_id % 2 = 1
UNION ALL SELECT page_id, 'handler', false FROM pages WHERE page_id % 6 = 2""")
def chk_dragging(spark, sf_dir):
    return behaviour.dragging(*_behaving(spark, sf_dir, *_DRAG)).select("page_id", "kind", "alternative")


_STATUS = (
    ("page_id % 2 = 0", "<form>f{{repeat('<form></form>', cast(page_id % 3 as int))}}</form>"),
    ("page_id % 5 = 0", "<div role='{{if(page_id % 3 = 0, 'alert', 'status')}}' {{if(page_id % 4 = 0, 'aria-atomic=\"true\"', '')}}>{{repeat('<p>', 20)}}<b class='toast'>t</b><input aria-invalid='true'></div>"),
    ("page_id % 7 = 0", "<div class='Toast-box'>t</div><input aria-invalid='false'>"),
    ("page_id % 11 = 0", "<span class='badge'>{{page_id % 13}}+</span><p id='search-results'>r</p>"),
)


@query("chk_status_messages", """
WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 + page_id % 3 ELSE 0 END AS forms, CAST(page_id % 5 = 0 AS BIGINT) AS live,
  concat_ws(',', CASE WHEN page_id % 2 = 0 THEN 'form' END, CASE WHEN page_id % 11 = 0 THEN 'results' END, CASE WHEN page_id % 11 = 0 THEN 'cart' END, CASE WHEN page_id % 7 = 0 THEN 'notice' END) AS contexts,
  CAST(page_id % 5 = 0 AND page_id % 3 = 0 AND page_id % 4 <> 0 AS BIGINT) AS not_atomic, CAST(page_id % 7 = 0 AS BIGINT) AS invalid FROM pages)
SELECT *, CASE WHEN contexts <> '' AND live = 0 THEN 'fail' WHEN contexts <> '' THEN 'incomplete' WHEN live > 0 THEN 'pass' ELSE 'incomplete' END AS status FROM s""")
def chk_status_messages(spark, sf_dir):
    els = kept(html.elements(appended(spark, sf_dir, *_STATUS)), "elements")
    return behaviour.status_messages(els)


_ALL = (
    "<style>.f { display: flex; flex-direction: row-reverse }</style><div class='{{if(page_id % 3 = 0, 'f', 'g')}}'><p>a</p><p>b</p></div>",
    "<form><label for='n'>Name</label><input id='n' autocomplete='name' {{if(page_id % 4 = 0, 'required', '')}}></form><div role='status'></div>",
    "<div><b draggable='{{page_id % 5 = 0}}'>x</b></div><video src='a.m3u8'></video><audio src='{{page_id}}.mp3' {{if(page_id % 2 = 0, 'aria-hidden=\"true\"', '')}}></audio>",
)


@query("audit_raw_pages", """
SELECT '1.3.2' AS wcag_sc, CAST(0 AS BIGINT) AS violations, count(*) FILTER (page_id % 3 = 0) AS needs_review, count(*) FILTER (page_id % 3 <> 0) AS passes FROM pages
UNION ALL SELECT '3.3.1', count(*) FILTER (page_id % 4 = 0), 0, count(*) FILTER (page_id % 4 <> 0) FROM pages
UNION ALL SELECT '2.5.7', 0, count(*) FILTER (page_id % 5 = 0), count(*) FILTER (page_id % 5 <> 0) FROM pages
UNION ALL SELECT '1.2.1', count(*) FILTER (page_id % 2 <> 0), 0, count(*) FILTER (page_id % 2 = 0) FROM pages
UNION ALL SELECT '4.1.3', 0, count(*), 0 FROM pages""")
def audit_raw_pages(spark, sf_dir):
    """Criteria whose rules read forms, media, styles and handlers, over tables that are made from raw pages."""
    tables = page_tables(appended(spark, sf_dir, *_ALL))
    report = audit(spark, tables, AuditConfig(level="AAA", criteria=("1.3.2", "3.3.1", "2.5.7", "1.2.1", "4.1.3")))
    found = report.findings.groupBy("wcag_sc").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("fail", "violations"), ("needs_review", "needs_review"), ("pass", "passes"))])
    return found.select("wcag_sc", "violations", "needs_review", "passes")


_ENTRY = (
    "<form id='one' class='{{if(page_id % 4 = 0, 'checkout', 'contact')}}'><label>Your email <input type='email' name='mail' required></label><input name='phone' {{if(page_id % 3 = 0, 'required', '')}}><input autocomplete='section-a billing postal-code' aria-label='zip' required></form>",
    "<form id='two' class='checkout'>{{repeat('<div>', cast(page_id % 20 as int))}}<label>Your email <input type='email' name='mail' required {{if(page_id % 5 = 0, 'value=\\'a@b\\'', '')}}></label><label>Confirm email<input type='email' required></label>",
    "<input name='phone' required {{if(page_id % 7 = 0, 'disabled', '')}}><input autocomplete='shipping postal-code' aria-label='zip' required></form>",
)


@query("chk_redundant_entry_pages", """
SELECT page_id AS page, 'email' AS key, CAST(1 AS DOUBLE) AS best, CASE WHEN page_id % 5 = 0 THEN 'pass' ELSE 'fail' END AS status FROM pages
UNION ALL SELECT page_id, 'tel', 1, 'fail' FROM pages WHERE page_id % 3 = 0 AND page_id % 7 <> 0""")
def chk_redundant_entry_pages(spark, sf_dir):
    els = kept(html.elements(appended(spark, sf_dir, *_ENTRY)), "elements")
    return redundant_entry(kept(entry_fields(els), "fields")).select("page", "key", F.col("best").cast("double").alias("best"), "status")
