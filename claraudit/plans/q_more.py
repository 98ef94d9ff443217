"""Queries of images, summaries, catalogue filters and the crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators import images as im
from claraudit.operators import reports
from claraudit.operators import rules_static as st
from claraudit.plans.q_findings import _F, findings
from claraudit.plans.q_geometry import _BOX, boxes
from claraudit.plans.q_rules import _LABEL, _MEDIA, _MOVE
from claraudit.plans.registry import Records, Registry, table
from claraudit.sources import crawl, records, sinks
from claraudit.sources.catalogue import catalogue, keyword_terms, values_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql
B = [True, False]
R = lambda **v: Records("orders", "o_orderkey", **v)

_CLASS = R(aria_hidden=[None, None, "true"], role=[None, None, "none"], in_button=[False, False, True], in_link=B, looks_logo=[False, True], chart_score=[0, 3], looks_icon=B, has_click=[False, True], alt=["x", "", None])
_CLASS_SQL = "CASE WHEN aria_hidden = 'true' OR role = 'none' THEN 'decorative/presentational' WHEN in_button THEN 'functional/buttons' WHEN in_link AND looks_logo THEN 'functional/logos' WHEN chart_score >= 3 THEN 'complex/charts' WHEN looks_icon AND (in_link OR has_click) THEN 'functional/icons' WHEN in_link OR has_click THEN 'functional/images' WHEN looks_logo THEN 'informative/logos' WHEN looks_icon THEN CASE WHEN alt = 'x' THEN 'informative/icons' ELSE 'decorative/decorative' END WHEN alt = 'x' THEN 'informative/images' WHEN alt = '' THEN 'decorative/decorative' ELSE 'decorative/missing_alt' END"


@query("fn_image_class", f"WITH r AS ({_CLASS.cte()}) SELECT k, {_CLASS_SQL} AS class FROM r")
def fn_image_class(spark, sf_dir):
    return _CLASS.frame(spark, sf_dir).select("k", im.image_class().alias("class"))


@query("agg_crawl_summary", f"WITH r AS ({_CLASS.cte()}), c AS (SELECT {_CLASS_SQL} AS class FROM r) SELECT split_part(class, '/', 1) AS classification, split_part(class, '/', 2) AS sub_type, count(*) AS n FROM c GROUP BY ALL")
def agg_crawl_summary(spark, sf_dir):
    parts = F.split(im.image_class(), "/")
    return _CLASS.frame(spark, sf_dir).select(parts[0].alias("classification"), parts[1].alias("sub_type")).groupBy("classification", "sub_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_image_report", f"WITH r AS ({_CLASS.cte()}), c AS (SELECT split_part({_CLASS_SQL}, '/', 1) AS classification, CASE WHEN alt = 'x' THEN 'PASSED' ELSE 'FAILED' END AS status, k % 4 = 0 AS ocr FROM r) SELECT coalesce(classification, 'all') AS classification, count(*) AS total, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (ocr) AS with_ocr FROM c GROUP BY ROLLUP (classification)")
def agg_image_report(spark, sf_dir):
    rows = _CLASS.frame(spark, sf_dir).select(F.split(im.image_class(), "/")[0].alias("classification"), F.when(F.col("alt") == "x", "PASSED").otherwise("FAILED").alias("status"), F.when(F.col("k") % 4 == 0, "t").alias("ocr_text"))
    return im.image_report(rows).withColumn("classification", F.coalesce("classification", F.lit("all")))


_REGION = "g AS (SELECT l_orderkey AS image, l_quantity / 5 AS ratio, CASE WHEN l_linenumber % 2 = 0 THEN 3.0 ELSE 4.5 END AS required FROM lineitem)"
for _name, _need in (("agg_contrast_report", "required"), ("agg_contrast_v1", "7.0")):

    @query(_name, f"WITH {_REGION}, p AS (SELECT image, count(*) AS n, count(*) FILTER (ratio < {_need}) AS bad FROM g GROUP BY image) SELECT CAST(sum(n) AS BIGINT) AS regions, CAST(sum(bad) AS BIGINT) AS violations, count(*) AS images, count(*) FILTER (bad > 0) AS failing, round((count(*) - count(*) FILTER (bad > 0)) * CAST(100 AS DOUBLE) / count(*), 1) AS pass_rate FROM p")
    def _contrast(spark, sf_dir, need=_need):
        required = F.lit(7.0) if need == "7.0" else F.when(F.col("l_linenumber") % 2 == 0, 3.0).otherwise(4.5)
        return im.contrast_report(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_quantity") / 5).alias("ratio"), required.alias("required")))


@query("join_ocr_by_name", "WITH o AS (SELECT lower('IMG' || (o_orderkey % 50) || '.png') AS name, arg_min('t' || o_orderkey, o_orderkey) AS words FROM orders GROUP BY 1) SELECT p_partkey, o.words AS ocr_text FROM part LEFT JOIN o ON o.name = 'img' || (p_partkey % 70) || '.png'")
def join_ocr_by_name(spark, sf_dir):
    ocr = table(spark, sf_dir, "orders").select(F.concat(F.lit("/ocr/IMG"), F.col("o_orderkey") % 50, F.lit(".png")).alias("path"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("words"), F.col("o_orderkey").alias("pos"))
    images = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("C:\\shots\\img"), F.col("p_partkey") % 70, F.lit(".PNG")).alias("path"))
    return im.with_ocr(images, ocr).select("p_partkey", "ocr_text")


_REFS = R(reason=["Image 'a/b.png' lacks text", "no file", "see c.JPG here", None], src=[None, "http://h/i/d.gif?x=1"], id=[None, "hero.webp", "main"])


@query("prj_image_ref", f"WITH r AS ({_REFS.cte()}) SELECT k, CASE WHEN reason LIKE 'Image%' THEN 'b.png' WHEN id = 'hero.webp' THEN 'hero.webp' WHEN src IS NOT NULL THEN 'd.gif' WHEN reason LIKE 'see%' THEN 'c.JPG' END AS reference FROM r")
def prj_image_ref(spark, sf_dir):
    return _REFS.frame(spark, sf_dir).select("k", im.image_reference(F.col("reason"), F.col("src"), F.col("id")).alias("reference"))


_FLAT = R(el_html=[None, "<a>"], html_snippet=["<b>", None, ""], el_selector=[None, "#x"], selector=["#y", None], target=["t1,t2", None])


@query("prj_flatten", f"WITH r AS ({_FLAT.cte()}) SELECT k, coalesce(nullif(html_snippet, ''), el_html, '') AS element_html, coalesce(el_selector, selector, split_part(target, ',', 1)) AS element_selector FROM r")
def prj_flatten(spark, sf_dir):
    c = F.col
    return _FLAT.frame(spark, sf_dir).select("k", *records.flat_element(c("html_snippet"), c("el_html"), [c("el_selector"), c("selector")], c("target")))


@query("agg_form_summary", f"WITH r AS ({_LABEL.cte()}) SELECT count(*) AS total, count(*) FILTER (NOT has_any_label) AS missing_label, count(*) FILTER (required OR coalesce(lower(aria_required), '') = 'true') AS required, round(count(*) FILTER (has_any_label) * CAST(100 AS DOUBLE) / count(*), 1) AS labelled_rate FROM r")
def agg_form_summary(spark, sf_dir):
    return records.form_summary(_LABEL.frame(spark, sf_dir))


_STATUS_SQL = "count(*) AS total, count(*) FILTER (status IN ('PASSED', 'FAILED')) AS checked, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'N/A') AS not_applicable"


@query("agg_target_summary", f"WITH {_BOX}, s AS (SELECT id % 3 AS tag, CASE WHEN fixed THEN 'N/A' WHEN w >= 24 AND h >= 24 THEN 'PASSED' ELSE 'FAILED' END AS status FROM b) SELECT tag, {_STATUS_SQL} FROM s GROUP BY tag")
def agg_target_summary(spark, sf_dir):
    b = boxes(spark, sf_dir).select((F.col("id") % 3).alias("tag"), F.col("w").alias("rendered_width_px"), F.col("h").alias("rendered_height_px"), F.col("fixed").alias("is_inline_exception"), F.lit(False).alias("is_ua_controlled_exception"), F.lit(False).alias("is_offset_exception"))
    return reports.status_summary(b.withColumn("status", st.target_size()["status"]), "tag")


@query("agg_psh_summary", f"WITH r AS ({_MOVE.cte()}), s AS (SELECT k % 6 AS content_type, CASE WHEN exception IS NOT NULL THEN 'N/A' WHEN NOT starts_automatically OR has_mechanism OR (NOT e AND duration_seconds <= 5) THEN 'PASSED' WHEN NOT e AND duration_seconds IS NULL AND NOT duration_known THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS status FROM (SELECT *, coalesce(duration_seconds = -1, false) OR coalesce(iteration_count = 'infinite', false) OR loops AS e FROM r)) SELECT content_type, {_STATUS_SQL} FROM s GROUP BY content_type")
def agg_psh_summary(spark, sf_dir):
    return reports.status_summary(_MOVE.frame(spark, sf_dir).select((F.col("k") % 6).alias("content_type"), st.pause_stop_hide()["status"].alias("status")), "content_type")


@query("agg_media_summary", f"WITH r AS ({_MEDIA.cte()}), s AS (SELECT kind, CASE WHEN src IN ('x.m3u8?z', 'live show.mp4') OR (kind = 'video' AND NOT (muted AND loop AND autoplay)) THEN 'N/A' WHEN is_labelled_alternative OR is_decorative THEN 'PASSED' WHEN NOT has_track AND coalesce(link_text, '') NOT LIKE '%Transcript%' AND length(coalesce(described_by, '')) <= 50 THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status FROM r) SELECT kind, {_STATUS_SQL} FROM s GROUP BY kind")
def agg_media_summary(spark, sf_dir):
    return reports.status_summary(_MEDIA.frame(spark, sf_dir).select("kind", st.audio_video()["status"].alias("status")), "kind")


_NAMED = R(label=["send", "***", "go"], name=["send it", "x", None])


@query("agg_label_summary", f"WITH r AS ({_NAMED.cte()}), s AS (SELECT label, CASE WHEN label = '***' THEN 'N/A' WHEN label = 'send' AND name = 'send it' THEN 'PASSED' ELSE 'FAILED' END AS status FROM r) SELECT label, {_STATUS_SQL} FROM s GROUP BY label")
def agg_label_summary(spark, sf_dir):
    return reports.status_summary(_NAMED.frame(spark, sf_dir).withColumn("status", st.label_in_name()["status"]).select("label", "status"), "label")


_SENS = R(page=["a", "b", "c"], categories=["shape,color", "color", "size"], status=["FAILED", "PASSED"])


@query("agg_sensory_summary", f"WITH r AS ({_SENS.cte()}) SELECT c AS category, count(*) AS n, count(DISTINCT page) AS pages FROM (SELECT page, unnest(string_split(categories, ',')) AS c FROM r WHERE status = 'FAILED') GROUP BY c")
def agg_sensory_summary(spark, sf_dir):
    return records.sensory_summary(_SENS.frame(spark, sf_dir))


_DENS = R(verbs=[0, 5, 20], adjectives=[0, 4, 9], n_words=[0, 50, 200])


@query("rule_visual_density", f"WITH r AS ({_DENS.cte()}) SELECT k, 'NEEDS_REVIEW' AS status, round(CASE WHEN n_words = 0 THEN 0 ELSE (verbs + adjectives) * CAST(1 AS DOUBLE) / n_words END, 4) AS density FROM r")
def rule_visual_density(spark, sf_dir):
    share = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise((F.col("verbs") + F.col("adjectives")) / F.col("n_words"))
    return _DENS.frame(spark, sf_dir).select("k", F.lit("NEEDS_REVIEW").alias("status"), F.round(share, 4).alias("density"))


_CATALOGUE = f"c AS (SELECT * FROM (VALUES {values_sql()}) t(wcag_sc, level, severity, name))"


@query("flt_guide", f"WITH {_F}, {_CATALOGUE} SELECT c.wcag_sc, c.level, count(f.wcag_sc) AS n FROM c LEFT JOIN f ON f.wcag_sc = c.wcag_sc WHERE c.level = 'AA' AND starts_with(c.wcag_sc, '1.4') GROUP BY ALL")
def flt_guide(spark, sf_dir):
    guide = catalogue(spark).filter((F.col("level") == "AA") & F.col("wcag_sc").startswith("1.4")).select("wcag_sc", "level")
    found = findings(spark, sf_dir).groupBy("wcag_sc").agg(F.count(F.lit(1)).alias("n"))
    return guide.join(found, "wcag_sc", "left").na.fill(0, ["n"])


@query("src_rules_yaml", f"WITH {_F}, {_CATALOGUE}, n AS (SELECT wcag_sc, count(*) AS n FROM f GROUP BY 1) SELECT c.level, count(*) AS criteria, count(c.severity) AS with_severity, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM c LEFT JOIN n ON n.wcag_sc = c.wcag_sc GROUP BY c.level")
def src_rules_yaml(spark, sf_dir):
    found = findings(spark, sf_dir).groupBy("wcag_sc").agg(F.count(F.lit(1)).alias("n"))
    return catalogue(spark).join(found, "wcag_sc", "left").groupBy("level").agg(F.count(F.lit(1)).alias("criteria"), F.count("severity").alias("with_severity"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


_TERMS = {"checks": {"help": {"words": {"en": ["the", "and", "in"], "de": ["der", "und", "In"], "ja": ["ヘルプ", "and"]}}}}


@query("src_keywords", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)the|and|der|und|in')) AS BIGINT) AS hits FROM documents WHERE regexp_matches(text, '(?i)the|and|der|und|in|ヘルプ')")
def src_keywords(spark, sf_dir):
    pattern = "(?i)" + text.keyword_pattern(keyword_terms(_TERMS, "help", "words"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("long").alias("hits"))


@query("src_seen_dedup", "SELECT o_custkey AS page_url, o_orderkey % 9 AS element_ref_id, min(o_orderkey) AS chunk FROM orders GROUP BY 1, 2")
def src_seen_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_url"), (F.col("o_orderkey") % 9).alias("element_ref_id"), F.col("o_orderkey").alias("chunk"))
    return sinks.unseen_records(rows).select("page_url", "element_ref_id", "chunk")


@query("src_normalize_records", "SELECT count(*) AS good, CAST(0 AS BIGINT) AS bad FROM events")
def src_normalize_records(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("page_url"), F.col("props").alias("body"))
    good, bad = sinks.normalize_records(raw, "k int", "http://d/")
    return good.agg(F.count(F.lit(1)).alias("good")).join(bad.agg(F.count(F.lit(1)).alias("bad")), F.lit(True))  # a row each


@query("src_bfs_crawl", """WITH l AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS source, CAST(o_orderkey * 7 % 200 AS VARCHAR) AS target, o_orderkey AS place FROM orders),
d1 AS (SELECT target AS url, row_number() OVER (ORDER BY place, target) AS r FROM (SELECT target, min(place) AS place FROM l WHERE source = '0' AND target <> '0' GROUP BY target) QUALIFY r <= 9),
d2 AS (SELECT target AS url, row_number() OVER (ORDER BY first_at, target) AS r FROM (SELECT l.target, min(d1.r * 1000000000000 + l.place) AS first_at FROM l JOIN d1 ON l.source = d1.url WHERE l.target <> '0' AND l.target NOT IN (SELECT url FROM d1) GROUP BY l.target) QUALIFY r <= 9 - (SELECT count(*) FROM d1))
SELECT '0' AS url, 0 AS depth UNION ALL SELECT url, 1 FROM d1 UNION ALL SELECT url, 2 FROM d2""")
def src_bfs_crawl(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    links = o.select((F.col("o_custkey") % 200).cast("string").alias("source"), (F.col("o_orderkey") * 7 % 200).cast("string").alias("target"), F.col("o_orderkey").alias("place"))
    return crawl.bfs(spark.sql("SELECT '0' AS url"), links, max_depth=2, max_pages=crawl.CrawlPolicy().max_pages)


@query("ext_frames", "SELECT o_custkey AS page, count(*) FILTER (o_orderkey % 4 <> 0) AS walked, count(*) FILTER (o_orderkey % 4 = 0) AS skipped, count(*) FILTER (o_orderkey % 4 = 0) > 0 AS partial FROM orders GROUP BY o_custkey")
def ext_frames(spark, sf_dir):
    return im.first_frames(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 4 != 0).alias("same_origin")))


@query("ext_context_chain", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'red' WHEN o_orderkey % 5 = 0 THEN 'blue' ELSE 'rgb(255, 255, 255)' END AS background FROM orders")
def ext_context_chain(spark, sf_dir):
    k = F.col("o_orderkey")
    layer = lambda c, a: F.struct(F.lit(c).alias("color"), a.cast("double").alias("alpha"))
    chain = F.array(layer("red", F.when(k % 3 == 0, 1.0).otherwise(0.0)), layer("blue", F.when(k % 5 == 0, 0.5).otherwise(0.0)))
    return table(spark, sf_dir, "orders").select(k.alias("k"), im.background(chain).alias("background"))


@query("ext_targets", f"WITH {_BOX} SELECT id, w < 24 OR h < 24 AS small, fixed AS inline FROM b")
def ext_targets(spark, sf_dir):
    return records.targets(boxes(spark, sf_dir).withColumnRenamed("fixed", "in_paragraph")).select("id", "small", "inline")


@query("fn_percentile_contrast", "SELECT l_orderkey AS image, round(quantile_cont(l_quantity / 50, 0.05), 6) AS dark, round(quantile_cont(l_quantity / 50, 0.95), 6) AS light FROM lineitem GROUP BY l_orderkey")
def fn_percentile_contrast(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_quantity") / 50).alias("luminance"))
    return im.region_contrast(px).select("image", F.round("dark", 6).alias("dark"), F.round("light", 6).alias("light"))


# Criteria and the stage of an audit that produces them.
STAGES = {"1.1.1": "image", "1.2.1": "media", "1.3.3": "sensory", "1.3.4": "orientation", "1.4.3": "ocr", "1.4.4": "resize_text", "1.4.5": "image", "1.4.6": "ocr", "1.4.10": "reflow", "1.4.11": "image", "1.4.12": "text_spacing", "1.4.13": "hover_focus_content", "2.2.2": "pause_stop_hide", "2.4.11": "focus_not_obscured_min", "2.4.12": "focus_not_obscured_enh", "2.5.3": "label_in_name", "2.5.8": "target_size", "3.3.1": "form", "3.3.2": "form"}


@query("flt_rule_flags", f"WITH {_F}, s AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in sorted(STAGES.items())) + ") t(wcag_sc, stage)) SELECT f.wcag_sc, stage, count(*) AS n FROM f JOIN s ON s.wcag_sc = f.wcag_sc GROUP BY ALL")
def flt_rule_flags(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    rows = findings(spark, sf_dir).filter("wcag_sc is not null").withColumn("stage", F.try_element_at(known, F.col("wcag_sc")))
    return rows.filter("stage is not null").groupBy("wcag_sc", "stage").agg(F.count(F.lit(1)).alias("n"))


_PIXELS = "SELECT l_suppkey AS image, CAST(floor((l_quantity * 5 + l_linenumber * 7 + l_suppkey % 40) % 256) AS BIGINT) AS v FROM lineitem"


@query("fn_otsu", f"""WITH h AS (SELECT image, v, count(*) AS c FROM ({_PIXELS}) GROUP BY ALL),
s AS (SELECT image, v, CAST(sum(c) OVER w AS DOUBLE) AS n0, CAST(sum(c * v) OVER w AS DOUBLE) AS s0, CAST(sum(c) OVER (PARTITION BY image) AS DOUBLE) AS n, CAST(sum(c * v) OVER (PARTITION BY image) AS DOUBLE) AS s FROM h WINDOW w AS (PARTITION BY image ORDER BY v)),
b AS (SELECT *, (n * s0 - n0 * s) * (n * s0 - n0 * s) / (n0 * (n - n0)) AS between_ FROM s WHERE n0 < n),
t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC, v) AS r FROM b)
SELECT i.image, v AS threshold, round(s0 / n0, 6) AS dark, round((s - s0) / (n - n0), 6) AS light FROM (SELECT DISTINCT image FROM h) i LEFT JOIN t ON t.image = i.image AND r = 1""")
def fn_otsu(spark, sf_dir):
    level = F.floor((F.col("l_quantity") * 5 + F.col("l_linenumber") * 7 + F.col("l_suppkey") % 40) % 256)
    found = im.otsu(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), level.alias("level")), "image")
    return found.select("image", "threshold", F.round("dark", 6).alias("dark"), F.round("light", 6).alias("light"))


_GRAPH = "g AS (SELECT 'http://h' || (o_custkey % 30) || '.example/p' || (o_custkey % 70) AS source, 'http://h' || (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 30 ELSE o_custkey % 30 END) || '.example/p' || (o_orderkey * 7 % 70) AS target, o_orderkey AS place FROM orders), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, target) AS n FROM g) WHERE n <= 50)"


def _round(depth: int, seen: str) -> str:
    """A round of the crawl in SQL: what the last round's pages link to, ranked in its host behind what has been visited."""
    before = f"d{depth - 1}"
    return f"""f{depth} AS (SELECT target AS url, min((rank, by_host, place)) AS best FROM (SELECT l.target, b.rank, b.host AS by_host, l.place FROM l JOIN {before} b ON b.url = l.source) WHERE target NOT IN (SELECT url FROM ({seen})) GROUP BY target),
n{depth} AS (SELECT url, regexp_extract(url, '//([^/]*)', 1) AS host, best FROM f{depth}),
d{depth} AS (SELECT * FROM (SELECT n.url, n.host, {depth} AS depth, CAST(coalesce(u.c, 0) + row_number() OVER (PARTITION BY n.host ORDER BY best, n.url) - 1 AS BIGINT) AS rank FROM n{depth} n LEFT JOIN (SELECT host, count(*) AS c FROM ({seen}) GROUP BY host) u ON u.host = n.host) WHERE rank < 25)"""


_D = [" UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(k)) for k in (1, 2, 3, 4)]


@query("src_bfs_crawl_hosts", f"""WITH {_GRAPH}, d0 AS (SELECT url, regexp_extract(url, '//([^/]*)', 1) AS host, 0 AS depth, CAST(0 AS BIGINT) AS rank FROM (VALUES ('http://h1.example/p1'), ('http://h2.example/p2')) t(url)),
{_round(1, _D[0])}, {_round(2, _D[1])}, {_round(3, _D[2])} {_D[3]}""")
def src_bfs_crawl_hosts(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    url = lambda host, page: F.concat(F.lit("http://h"), host.cast("string"), F.lit(".example/p"), page.cast("string"))
    links = table(spark, sf_dir, "orders").select(url(c % 30, c % 70).alias("source"), url(F.when(o % 3 == 0, o % 30).otherwise(c % 30), o * 7 % 70).alias("target"), o.alias("place"))
    seeds = links.select("source").distinct().filter(F.col("source").isin("http://h1.example/p1", "http://h2.example/p2")).union(spark.sql("SELECT * FROM VALUES ('http://h1.example/p1'), ('http://h2.example/p2')")).toDF("url")
    return crawl.frontier(seeds, links, crawl.CrawlPolicy(max_depth=3, max_pages=25, same_origin=False))
