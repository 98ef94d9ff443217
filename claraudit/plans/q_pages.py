"""Queries over `pages`: links, addresses, page-level checks and the findings that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.functions import urls
from claraudit.operators import checks, page_links
from claraudit.plans.audit import AuditConfig, audit
from claraudit.plans.registry import Registry, appended, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_VALUE = page_links.VALUE.replace("'", "''")
_SHOWN = r"""shown AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script.*?</script\s*>', '', 'g'), '(?is)<style.*?</style\s*>', '', 'g') AS html FROM pages)"""
# pieces between the signs that open a tag: a link is its own piece and those up to the next start or end of a link
_PIECES = r"""pieces AS (SELECT page_id, url, i, p, i > 1 AND regexp_matches(p, '(?i)^/?a[\s>]') AS edge, CASE WHEN i = 1 THEN p ELSE substr(p, instr(p, '>') + 1) END AS behind FROM (
  SELECT page_id, url, unnest(string_split(html, '<')) AS p, generate_subscripts(string_split(html, '<'), 1) AS i FROM shown))"""
_HREF = r"""regexp_extract(p, '(?is)\shref\s*=\s*["'']?([^"''>]*)', 1)"""
_LINKS_SQL = f"""
{_SHOWN}, {_PIECES},
runs AS (SELECT *, sum(CAST(edge AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS run FROM pieces),
heads AS (SELECT page_id, url, run, row_number() OVER (PARTITION BY page_id ORDER BY run) AS pos, {_HREF} AS href FROM runs WHERE edge AND regexp_matches(p, '(?i)^a\\s[^>]*href')),
links AS (SELECT h.page_id, h.url, h.pos, h.href, trim(regexp_replace((SELECT string_agg(behind, '' ORDER BY i) FROM runs r WHERE r.page_id = h.page_id AND r.run = h.run), '\\s+', ' ', 'g')) AS text FROM heads h),
parts AS (
  SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM links),
abs AS (
  SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '/') THEN scheme || '://' || authority || href
    WHEN starts_with(href, '?') THEN scheme || '://' || authority || path || href
    ELSE scheme || '://' || authority || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target FROM parts)"""

_NORM_SQL = r"""
u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS authority,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
n AS (
  SELECT page_id, url, scheme, authority, q, path, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS short,
    list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: {'k': split_part(p, '=', 1), 'v': CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END}),
      lambda x: lower(x.k) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','_ga','msclkid','mc_cid','mc_eid'))) AS kept FROM u),
norm AS (
  SELECT page_id, url, scheme, authority, path, q, scheme || '://' || authority || short || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN x.v = '' THEN x.k ELSE x.k || '=' || x.v END), '&') END AS normalized FROM n)"""


@query("src_url_normalize", f"WITH {_NORM_SQL} SELECT page_id, normalized FROM norm")
def src_url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query("fn_url_path_query", f"WITH {_NORM_SQL} SELECT page_id, path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS path_query FROM norm")
def fn_url_path_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.path_query(F.col("url")).alias("path_query"))


@query("src_same_host", f"WITH {_LINKS_SQL} SELECT page_id, count(*) AS n_links, count(*) FILTER (lower(regexp_extract(target, '^[A-Za-z]+://([^/?#:]*)', 1)) = lower(authority)) AS n_same_host FROM abs GROUP BY page_id")
def src_same_host(spark, sf_dir):
    links = page_links.absolute_links(table(spark, sf_dir, "pages"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(urls.same_host(F.col("target"), F.col("url"))).alias("n_same_host"))


@query("src_same_origin", f"WITH {_LINKS_SQL} SELECT page_id, pos, regexp_extract(target, '^([A-Za-z]+://[^/?#]*)', 1) = scheme || '://' || authority AS same FROM abs")
def src_same_origin(spark, sf_dir):
    links = page_links.absolute_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", urls.same_origin(F.col("target"), F.col("url")).alias("same"))


@query("src_links", f"WITH {_LINKS_SQL} SELECT page_id, target, min(pos) AS pos FROM abs WHERE starts_with(target, scheme || '://' || authority) GROUP BY page_id, target")
def src_links(spark, sf_dir):
    links = page_links.absolute_links(table(spark, sf_dir, "pages"))
    return page_links.first_seen(links.filter(urls.same_origin(F.col("target"), F.col("url"))), "target")


@query("src_link_cap", f"WITH {_LINKS_SQL} SELECT page_id, pos, target FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM abs) WHERE r <= 50")
def src_link_cap(spark, sf_dir):
    return page_links.cap(page_links.absolute_links(table(spark, sf_dir, "pages")), 50).select("page_id", "pos", "target")


@query("src_page_summary", f"WITH {_LINKS_SQL} SELECT p.page_id, coalesce(l.n, 0) AS links_found, CAST(len(regexp_extract_all(p.html, '(?i)<h1[\\s>]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(p.html, '(?i)<p[\\s>]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(p.html, '(?i)<li[\\s>]')) AS BIGINT) AS items FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY page_id) l ON l.page_id = p.page_id")
def src_page_summary(spark, sf_dir):
    return page_links.page_summary(table(spark, sf_dir, "pages"))


@query("set_distinct_ordered", f"WITH {_LINKS_SQL} SELECT page_id, href, min(pos) AS first_pos FROM links GROUP BY page_id, href")
def set_distinct_ordered(spark, sf_dir):
    return page_links.first_seen(page_links.links(table(spark, sf_dir, "pages")), "href").withColumnRenamed("pos", "first_pos")


_PAGE_URLS = f"WITH {_NORM_SQL}, {_LINKS_SQL.strip()}"


@query("set_intersection_except", f"{_PAGE_URLS} SELECT DISTINCT a.target, a.target IN (SELECT normalized FROM norm) AS known FROM abs a")
def set_intersection_except(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = pages.select(urls.normalize(F.col("url")).alias("target")).distinct()
    found = page_links.absolute_links(pages).select("target").distinct()
    return found.join(known, "target", "left_semi").withColumn("known", F.lit(True)).unionByName(found.join(known, "target", "left_anti").withColumn("known", F.lit(False)))


@query("chk_link_purpose", f"WITH {_LINKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM links) SELECT page_id, pos, text, regexp_matches(lower(text), '^({checks.GENERIC_LINKS})\\.?$') AS generic FROM r WHERE n <= 2000 AND text <> ''")
def chk_link_purpose(spark, sf_dir):
    return checks.link_purpose(page_links.links(table(spark, sf_dir, "pages"))).select("page_id", "pos", "text", "generic")


#: What checks must tell apart: names and types of elements, structured data, and the same words in comments, scripts and texts.
_ODD = (
    ("page_id % 9 = 0", '<div class="x Breadcrumbs">b</div>'),
    ("page_id % 9 = 1", '<!-- <div class="breadcrumb"></div> <p id="a0"> --><!-- <a href="/site-map">site map</a>'.replace(" <a", " --><!-- <a") + " -->"),
    ("page_id % 9 = 2", "<script>var x = '<nav class=\"breadcrumb\" id=\"a1\"></nav>', y = 'role=\"search\"'</script>"),
    ("page_id % 9 = 3", '<script type="application/ld+json">{"@type": "BreadcrumbList", "n": 1}</script>'),
    ("page_id % 9 = 4", "<a href='/help/site-map'></a>"),
    ("page_id % 9 = 5", "<p aria-current=step>2</p>"),
    ("page_id % 9 = 6", "<p title=\"id='q' breadcrumb\">breadcrumb, sitemap, type=search</p>"),
    '<i id="a{{page_id % 3}}"></i><i ID=a{{page_id % 4}}></i><label for=\'a{{page_id % 5}}\'></label><i aria-describedby="a{{page_id % 3}} zz"></i>',
)


@query("chk_location", "SELECT page_id, CASE WHEN page_id % 9 IN (0, 3, 4, 5) THEN 'pass' ELSE 'incomplete' END AS status FROM pages")
def chk_location(spark, sf_dir):
    return checks.location(appended(spark, sf_dir, *_ODD)).select("page_id", "status")


@query("chk_multiple_ways", f"""
WITH {_SHOWN}, w AS (SELECT page_id, CAST(regexp_matches(html, '(?i)<nav[ >]') AS BIGINT) + CAST(page_id % 9 IN (0, 4) AS BIGINT) AS ways FROM shown)
SELECT page_id, ways, CASE WHEN ways >= 2 THEN 'pass' ELSE 'incomplete' END AS status FROM w""")
def chk_multiple_ways(spark, sf_dir):
    return checks.multiple_ways(appended(spark, sf_dir, *_ODD)).select("page_id", "ways", "status")


@query("chk_consistent_help", """
WITH w AS (SELECT page_id, list_filter(['link', 'widget', 'phone', 'mail'], lambda x: CASE x
  WHEN 'link' THEN regexp_matches(html, '(?i)<a [^>]*>[^<]*(help|support|contact|faq)[^<]*</a>')
  WHEN 'widget' THEN regexp_matches(html, '(?i)(class|id)="[^"]*(chat|helpdesk|intercom|zendesk)')
  WHEN 'phone' THEN regexp_matches(html, '(?i)href="tel:') ELSE regexp_matches(html, '(?i)href="mailto:') END) AS kinds FROM pages)
SELECT page_id, array_to_string(kinds, ',') AS kinds, CASE WHEN len(kinds) > 0 THEN 'pass' ELSE 'incomplete' END AS status FROM w""")
def chk_consistent_help(spark, sf_dir):
    return checks.consistent_help(table(spark, sf_dir, "pages")).select("page_id", "kinds", "status")


@query("chk_pronunciation", r"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?i)<html\b[^>]*\slang""" + _VALUE + r"""', 1) || regexp_extract(html, '(?i)<html\b[^>]*\slang""" + _VALUE + r"""', 2) || regexp_extract(html, '(?i)<html\b[^>]*\slang""" + _VALUE + r"""', 3) AS lang,
  regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body, html FROM pages),
d AS (SELECT *, length(regexp_replace(body, '[\x{4E00}-\x{9FFF}]', '', 'g')) AS rest, length(regexp_replace(body, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]', '', 'g')) AS not_cjk FROM t)
SELECT page_id, lang, CASE WHEN NOT (regexp_matches(lower(lang), '^(ja|zh|ko)(-|$)') OR (length(body) > 0 AND (length(body) - not_cjk) * 1.0 / length(body) >= 0.05)) THEN 'pass'
  WHEN length(body) = rest THEN 'pass' WHEN regexp_matches(html, '(?i)<ruby[ >]') THEN 'incomplete' ELSE 'fail' END AS status FROM d""")
def chk_pronunciation(spark, sf_dir):
    return checks.pronunciation(table(spark, sf_dir, "pages")).select("page_id", "lang", "status")


@query("chk_html_parsing", """
WITH n AS (SELECT page_id, CAST(page_id % 3 = page_id % 4 AS BIGINT) AS duplicate_ids, 1 + CAST(page_id % 5 <> page_id % 3 AND page_id % 5 <> page_id % 4 AS BIGINT) AS broken_refs FROM pages)
SELECT page_id, duplicate_ids, broken_refs, 'fail' AS status FROM n""")
def chk_html_parsing(spark, sf_dir):
    return checks.html_parsing(appended(spark, sf_dir, *_ODD))


@query("st_dedup", f"WITH {_LINKS_SQL} SELECT href, count(*) AS n FROM (SELECT DISTINCT page_id, href FROM links) GROUP BY href")
def st_dedup(spark, sf_dir):
    return page_links.links(table(spark, sf_dir, "pages")).dropDuplicates(["page_id", "href"]).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


# all links, where chk_link_purpose has the first ones of a page
_PURPOSE = f"WITH {_LINKS_SQL} SELECT regexp_matches(lower(text), '^({checks.GENERIC_LINKS})\\.?$') AS generic FROM links WHERE text <> ''"


@query("audit_pages", f"""WITH a AS (SELECT '2.4.9' AS wcag_sc, CASE WHEN generic THEN 'fail' ELSE 'pass' END AS status FROM ({_PURPOSE})
  UNION ALL SELECT '2.4.8', status FROM ({SQL["chk_location"]}) UNION ALL SELECT '2.4.5', status FROM ({SQL["chk_multiple_ways"]}) UNION ALL SELECT '3.2.6', status FROM ({SQL["chk_consistent_help"]})
  UNION ALL SELECT '4.1.1', status FROM ({SQL["chk_html_parsing"]}) UNION ALL SELECT '3.1.6', status FROM ({SQL["chk_pronunciation"]}))
SELECT wcag_sc, count(*) FILTER (status = 'fail') AS violations, count(*) FILTER (status = 'incomplete') AS needs_review, count(*) FILTER (status = 'pass') AS passes FROM a GROUP BY wcag_sc""")
def audit_pages(spark, sf_dir):
    """The audit plan over raw pages: findings by criterion and status."""
    report = audit(spark, {"pages": appended(spark, sf_dir, *_ODD)}, AuditConfig(level="AAA"))
    return report.by_dimension.filter("dimension = 'wcag_sc'").select(F.col("value").alias("wcag_sc"), "violations", "needs_review", "passes")
