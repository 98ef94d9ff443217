"""Queries over boxes and snapshots that are arithmetic on the keys of `part`: 40 boxes a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.functions import rects
from claraudit.operators import boxes as bx
from claraudit.operators import rendered as rn
from claraudit.plans.registry import Records, Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_BOX = "b AS (SELECT p_partkey // 40 AS page, p_partkey AS id, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 91 % 800 AS DOUBLE) AS y, CAST(10 + p_partkey % 31 AS DOUBLE) AS w, CAST(8 + p_partkey * 7 % 29 AS DOUBLE) AS h, p_partkey % 7 = 0 AS fixed FROM part)"
_PAIRS = f"{_BOX}, p AS (SELECT a.page, a.id, a.x, a.y, a.w, a.h, o.id AS oid, o.x AS ox, o.y AS oy, o.w AS ow, o.h AS oh, o.fixed AS ofixed, greatest(0, o.x - a.x - a.w, a.x - o.x - o.w) AS dx, greatest(0, o.y - a.y - a.h, a.y - o.y - o.h) AS dy FROM b a LEFT JOIN b o ON o.page = a.page AND o.id <> a.id)"


def boxes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 40).alias("page"), k.alias("id"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 800).cast("double").alias("y"), (k % 31 + 10).cast("double").alias("w"), (k * 7 % 29 + 8).cast("double").alias("h"), (k % 7 == 0).alias("fixed"))


@query("join_nearest_gap", f"WITH {_PAIRS} SELECT page, id, coalesce(min(greatest(dx, dy)), 0.0) AS gap FROM p GROUP BY page, id")
def join_nearest_gap(spark, sf_dir):
    return bx.nearest_gap(boxes(spark, sf_dir))


@query("join_offset_exception", f"WITH {_PAIRS} SELECT page, id, min(dx) AS gap_x, min(dy) AS gap_y, (any_value(w) < 24 OR any_value(h) < 24) AND NOT coalesce(bool_or(ox + ow > x - greatest(0, 12 - w / 2) AND ox < x + w + greatest(0, 12 - w / 2) AND oy + oh > y - greatest(0, 12 - h / 2) AND oy < y + h + greatest(0, 12 - h / 2)), false) AS offset_exception FROM p GROUP BY page, id")
def join_offset_exception(spark, sf_dir):
    return bx.offset_exception(boxes(spark, sf_dir))


_OBS = f"{_PAIRS}, o AS (SELECT page, id, greatest(0, least(x + w, ox + ow) - greatest(x, ox)) * greatest(0, least(y + h, oy + oh) - greatest(y, oy)) / (w * h) AS ratio, ofixed FROM p), s AS (SELECT page, id, round(coalesce(max(ratio) FILTER (ofixed), 0), 4) AS ratio, count(*) FILTER (ofixed AND ratio > 0.05) AS n_covering FROM o GROUP BY page, id)"


def _steps(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return bx.obscuration(b, b.filter("fixed"))


@query("join_obscuration", f"WITH {_OBS} SELECT page, id, ratio, n_covering FROM s")
def join_obscuration(spark, sf_dir):
    return _steps(spark, sf_dir)


for _name, _fail, _review in (("ren_focus_min", 0.95, 0.10), ("ren_focus_enh", 0.10, 0.02)):

    @query(_name, f"WITH {_OBS}, h AS (SELECT page, id, CASE WHEN ratio >= {_fail} THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status FROM s WHERE ratio >= {_review}) SELECT page, CAST(id AS VARCHAR) AS id, status FROM h UNION ALL SELECT DISTINCT page, NULL, 'PASSED' FROM b WHERE page NOT IN (SELECT page FROM h)")
    def _focus(spark, sf_dir, fail=_fail, review=_review):
        return bx.focus_not_obscured(_steps(spark, sf_dir), boxes(spark, sf_dir).select("page").distinct(), fail, review).withColumn("id", F.col("id").cast("string"))


@query("fn_rect_intersects", f"WITH {_PAIRS} SELECT page, id AS a, oid AS b FROM p WHERE id < oid AND x < ox + ow AND x + w > ox AND y < oy + oh AND y + h > oy")
def fn_rect_intersects(spark, sf_dir):
    return bx.overlapping_pairs(boxes(spark, sf_dir))


@query("fn_rect_offscreen", f"WITH {_BOX} SELECT id, x >= 320 OR y >= 640 OR x + w <= 0 OR y + h <= 0 AS offscreen FROM b")
def fn_rect_offscreen(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", rects.offscreen(rects.Box(), 320, 640).alias("offscreen"))


_STYLE = Records("orders", "o_orderkey", visible=[True, False], opacity=[1.0, 0.0, 0.5], display=["block", "none", None], visibility=["visible", "hidden", "collapse"], scroll=[100.0, 104.0, 105.0, 106.0], client=[100.0, 101.0], overflow=["hidden", "clip", "auto", None])


@query("fn_rect_hidden", f"WITH r AS ({_STYLE.cte()}) SELECT k, NOT visible OR opacity = 0 OR coalesce(display, '') = 'none' OR visibility <> 'visible' AS hidden, scroll > client + 5 AS scrolls, coalesce(overflow, '') IN ('hidden', 'clip') AND scroll > client + 4 AS clipped FROM r")
def fn_rect_hidden(spark, sf_dir):
    c = F.col
    return _STYLE.frame(spark, sf_dir).select("k", rects.hidden(c("visible"), c("opacity"), F.coalesce(c("display"), F.lit("")), c("visibility")).alias("hidden"), rects.horizontal_scroll(c("scroll"), c("client")).alias("scrolls"), rects.overflow_clipped(c("scroll"), c("client"), c("overflow")).alias("clipped"))


@query("ext_visibility_filter", f"WITH r AS ({_STYLE.cte()}) SELECT k FROM r WHERE visible AND opacity <> 0 AND coalesce(display, '') <> 'none' AND visibility = 'visible'")
def ext_visibility_filter(spark, sf_dir):
    chain = F.array(F.struct(F.lit(True).alias("v"), F.lit("block").alias("d")), F.struct(F.col("visible").alias("v"), F.col("display").alias("d")))
    gone = F.exists(chain, lambda a: ~a["v"] | (F.coalesce(a["d"], F.lit("")) == "none"))
    return _STYLE.frame(spark, sf_dir).filter(~gone & (F.col("opacity") != 0) & (F.col("visibility") == "visible")).select("k")


_SNAP = "e AS (SELECT l_orderkey % 400 AS page, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS key, list_extract(['baseline', 'zoom', 'spacing', 'narrow'], CAST(l_suppkey % 4 + 1 AS BIGINT)) AS scenario, l_quantity % 3 = 0 AS clipped, l_quantity % 5 <> 0 AS visible, l_partkey % 2 = 0 AS overflows, l_partkey % 11 < 9 AS exempt FROM lineitem), p AS (SELECT DISTINCT l_orderkey % 400 AS page, (l_orderkey % 400) % 3 = 0 AS scroll_after, (l_orderkey % 400) % 6 = 0 AS scroll_before FROM lineitem)"


def _snapshots(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    page = F.col("l_orderkey") % 400
    e = li.select(page.alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("key"), F.element_at(F.array(*[F.lit(s) for s in ("baseline", "zoom", "spacing", "narrow")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("scenario"), (F.col("l_quantity") % 3 == 0).alias("clipped"), (F.col("l_quantity") % 5 != 0).alias("visible"), (F.col("l_partkey") % 2 == 0).alias("overflows"), (F.col("l_partkey") % 11 < 9).alias("exempt"))
    p = li.select(page.alias("page"), (page % 3 == 0).alias("scroll_after"), (page % 6 == 0).alias("scroll_before")).distinct()
    return e, p


def _clip_sql(scenario: str, scroll: str) -> str:
    return f"WITH {_SNAP}, c AS (SELECT page, key FROM (SELECT n.page, n.key, row_number() OVER (PARTITION BY n.page ORDER BY n.key) AS r FROM e n WHERE n.scenario = '{scenario}' AND n.clipped AND n.visible AND EXISTS (SELECT 1 FROM e b WHERE b.scenario = 'baseline' AND b.page = n.page AND b.key = n.key AND NOT b.clipped AND b.visible)) WHERE r <= 10), h AS (SELECT page, key, 'FAILED' AS status FROM c UNION ALL SELECT page, -1, '{scroll}' FROM p WHERE scroll_after AND NOT scroll_before) SELECT page, CAST(key AS VARCHAR) AS key, status FROM h UNION ALL SELECT page, NULL, 'PASSED' FROM p WHERE page NOT IN (SELECT page FROM h)"


@query("ren_resize", _clip_sql("zoom", "FAILED"))
def ren_resize(spark, sf_dir):
    return rn.resize_text(*_snapshots(spark, sf_dir)).withColumn("key", F.col("key").cast("string"))


@query("ren_text_spacing", _clip_sql("spacing", "NEEDS_REVIEW"))
def ren_text_spacing(spark, sf_dir):
    return rn.text_spacing(*_snapshots(spark, sf_dir)).withColumn("key", F.col("key").cast("string"))


@query("join_snapshot_diff", f"WITH {_SNAP} SELECT n.page, n.key FROM e n WHERE n.scenario = 'zoom' AND EXISTS (SELECT 1 FROM e b WHERE b.scenario = 'baseline' AND b.page = n.page AND b.key = n.key)")
def join_snapshot_diff(spark, sf_dir):
    e, _ = _snapshots(spark, sf_dir)
    return e.filter("scenario = 'zoom'").join(e.filter("scenario = 'baseline'").select("page", "key").distinct(), ["page", "key"], "left_semi").select("page", "key")


@query("ren_reflow", f"WITH {_SNAP}, o AS (SELECT page, count(*) AS n, bool_and(exempt) AS ae FROM e WHERE scenario = 'narrow' AND overflows AND visible GROUP BY page), t AS (SELECT page, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS shown FROM (SELECT page, key, row_number() OVER (PARTITION BY page ORDER BY key) AS r FROM e WHERE scenario = 'narrow' AND overflows AND visible AND NOT exempt) WHERE r <= 3 GROUP BY page), s AS (SELECT p.page, CASE WHEN NOT scroll_after THEN 'PASSED' WHEN o.ae THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS status, coalesce(o.n, 0) AS n, t.shown FROM p LEFT JOIN o ON o.page = p.page LEFT JOIN t ON t.page = p.page) SELECT page, status, n, CASE WHEN status = 'FAILED' THEN coalesce(shown, '') ELSE '' END AS shown FROM s")
def ren_reflow(spark, sf_dir):
    return rn.reflow(*_snapshots(spark, sf_dir))


_ORI = "e AS (SELECT o_orderkey // 8 AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS scenario, CASE WHEN o_orderkey % 97 = 0 THEN 'Please rotate your device' ELSE 'some text of reasonable length here' END AS text, o_custkey % 3 <> 0 AS visible, CASE WHEN o_custkey % 5 = 0 THEN 'div' ELSE 'p' END AS tag FROM orders), p AS (SELECT DISTINCT o_orderkey // 8 AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS scenario, CASE WHEN (o_orderkey // 8) % 5 = 0 THEN 'Rotate(90deg)' ELSE 'none' END AS transform, CASE WHEN (o_orderkey // 8) % 4 = 0 THEN 'hidden' ELSE 'visible' END AS overflow_x, ((o_orderkey // 8) % 3 = 0 AND o_orderkey % 2 = 1) OR (o_orderkey // 8) % 6 = 0 AS scrolls FROM orders)"


@query("ren_orientation", f"WITH {_ORI}, g AS (SELECT page, scenario, bool_or(text LIKE '%rotate your device%') AS rot, count(*) FILTER (visible AND tag = 'p' AND length(text) > 20) AS texts FROM e GROUP BY ALL) SELECT p.page, p.scenario, concat_ws(',', CASE WHEN g.rot THEN 'rotate_notice' END, CASE WHEN coalesce(g.texts, 0) < 3 THEN 'missing_content' END, CASE WHEN p.transform <> 'none' THEN 'transform_lock' END, CASE WHEN p.overflow_x = 'hidden' THEN 'overflow_hidden' END, CASE WHEN p.scenario = 'landscape' AND p.scrolls AND NOT EXISTS (SELECT 1 FROM p q WHERE q.page = p.page AND q.scenario = 'portrait' AND q.scrolls) THEN 'landscape_scroll' END) AS codes FROM p LEFT JOIN g ON g.page = p.page AND g.scenario = p.scenario")
def ren_orientation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o, page = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 8)
    scenario = F.when(k % 2 == 0, "portrait").otherwise("landscape").alias("scenario")
    e = o.select(page.alias("page"), scenario, F.when(k % 97 == 0, "Please rotate your device").otherwise("some text of reasonable length here").alias("text"), (c % 3 != 0).alias("visible"), F.when(c % 5 == 0, "div").otherwise("p").alias("tag"))
    p = o.select(page.alias("page"), scenario, F.when(page % 5 == 0, "Rotate(90deg)").otherwise("none").alias("transform"), F.when(page % 4 == 0, "hidden").otherwise("visible").alias("overflow_x"), (((page % 3 == 0) & (k % 2 == 1)) | (page % 6 == 0)).alias("scrolls")).distinct()
    return rn.orientation(e, p)


_HOVER = Records("orders", "o_orderkey", appeared=[True, True, False], dismissable=[True, False, None], hoverable=[True, False, None], persistent=[True, False, None], certain=[False, True])


@query("ren_hover", f"WITH r AS ({_HOVER.cte()}), c AS (SELECT *, dismissable IS FALSE OR hoverable IS FALSE OR persistent IS FALSE AS f, dismissable IS NULL OR hoverable IS NULL OR persistent IS NULL AS u FROM r) SELECT k, CASE WHEN NOT appeared THEN 'PASSED' WHEN f AND (NOT u OR certain) THEN 'FAILED' WHEN f OR u THEN 'NEEDS_REVIEW' ELSE 'PASSED' END AS status FROM c")
def ren_hover(spark, sf_dir):
    return rn.hover_content(_HOVER.frame(spark, sf_dir)).select("k", "status")
