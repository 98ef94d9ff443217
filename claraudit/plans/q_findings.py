"""Queries over a findings table: filters, merge, reports, ordering and limits.

The findings run through all combinations of sources, criteria, statuses and element identities by the keys of `orders`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.operators import findings as fi
from claraudit.operators import reports
from claraudit.plans.registry import Records, Registry
from claraudit.sources.catalogue import catalogue, overlay_names, values_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql

_R = Records(
    "orders", "o_orderkey",
    status=["fail", "pass", "needs_review", "pass", "fail"],
    source=["python", "axe", "custom"],
    wcag_sc=["1.1.1", "1.4.3", "2.5.8", "1.4.10", "3.3.1", "4.1.2", None, "1.4.6"],
    severity=["critical", "high", None, "medium", "low", "serious"],
    selector=["#a  b", None, "", "nav > a"],
    element_id=[None, "Main", ""],
    html=["<a  href='x'>Go</a>", None, "<B>x</B>"],
    page_url=["http://a.example/", "http://b.example/x", None],
)
_CAT = f"cat AS (SELECT * FROM (VALUES {values_sql()}) AS t(wcag_sc, level, sev, name))"
_F = f"""{_CAT}, r AS ({_R.cte()}), f AS (
  SELECT r.k AS pos, r.source, 'rule-' || coalesce(r.wcag_sc, 'none') AS rule_id, r.wcag_sc, r.status, 'reason ' || (r.k % 7) AS reason,
    CASE WHEN r.status = 'pass' THEN NULL ELSE r.severity END AS severity, cat.level, cat.name AS criterion_name,
    r.selector, r.element_id, r.html, r.page_url FROM r LEFT JOIN cat ON cat.wcag_sc = r.wcag_sc)"""


def findings(spark, sf_dir):
    rows = _R.frame(spark, sf_dir).select(F.col("k").alias("pos"), "source", F.concat(F.lit("rule-"), F.coalesce("wcag_sc", F.lit("none"))).alias("rule_id"), "wcag_sc", "status", F.concat(F.lit("reason "), (F.col("k") % 7).cast("string")).alias("reason"), "severity", "selector", "element_id", "html", "page_url")
    return fi.make_findings(rows, catalogue(spark))


@query("prj_finding", f"""WITH {_F} SELECT pos, source, rule_id, wcag_sc, status, severity, level, criterion_name,
  (status <> 'pass' OR trim(coalesce(html, '')) <> '' OR coalesce(element_id, '') <> '' OR coalesce(selector, '') <> '') AS has_element,
  CASE WHEN (status <> 'pass' OR trim(coalesce(html, '')) <> '' OR coalesce(element_id, '') <> '' OR coalesce(selector, '') <> '') THEN substr(coalesce(html, ''), 1, 600) END AS html FROM f""")
def prj_finding(spark, sf_dir):
    return findings(spark, sf_dir).select("pos", "source", "rule_id", "wcag_sc", "status", "severity", "level", "criterion_name", F.col("element").isNotNull().alias("has_element"), F.col("element.html").alias("html"))


@query("join_catalogue", f"WITH {_F} SELECT wcag_sc, criterion_name, level, count(*) AS n FROM f GROUP BY ALL")
def join_catalogue(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("wcag_sc", "criterion_name", "level").agg(F.count(F.lit(1)).alias("n"))


@query("flt_level", f"WITH {_F} SELECT pos, level FROM f WHERE level IN ('A', 'AA') OR level IS NULL")
def flt_level(spark, sf_dir):
    return fi.filter_level(findings(spark, sf_dir), "AA").select("pos", "level")


@query("flt_rule", f"WITH {_F} SELECT pos, wcag_sc FROM f WHERE wcag_sc = '1.4.3'")
def flt_rule(spark, sf_dir):
    return findings(spark, sf_dir).filter(F.col("wcag_sc") == "1.4.3").select("pos", "wcag_sc")


@query("flt_facets", f"WITH {_F} SELECT pos FROM f WHERE severity IN ('high', 'medium') AND source IN ('axe', 'python') AND (contains(lower(coalesce(criterion_name, '')), 'contrast') OR contains(lower(coalesce(reason, '')), 'contrast') OR contains(lower(coalesce(rule_id, '')), 'contrast'))")
def flt_facets(spark, sf_dir):
    return fi.filter_facets(findings(spark, sf_dir), {"severity": ["high", "medium"], "source": ["axe", "python"], "wcag_sc": []}, "Contrast", ("criterion_name", "reason", "rule_id")).select("pos")


_IDENT = """ident AS (SELECT *, lower(trim(coalesce(page_url, ''))) AS scope,
  lower(trim(regexp_replace(coalesce(selector, ''), '\\s+', ' ', 'g'))) AS sel, lower(trim(coalesce(element_id, ''))) AS eid,
  lower(trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g'))) AS flat FROM f),
keyed AS (SELECT *, CASE WHEN sel <> '' THEN 'sel:' || scope || '|' || sel WHEN eid <> '' THEN 'id:' || scope || '||' || eid
  WHEN flat <> '' THEN 'html:' || scope || '||' || substr(sha1(substr(flat, 1, 400)), 1, 16) ELSE '' END AS ident FROM (SELECT * FROM ident WHERE NOT (status = 'pass' AND flat = '' AND eid = '' AND sel = '')
  UNION ALL SELECT * REPLACE ('' AS scope) FROM ident WHERE status = 'pass' AND flat = '' AND eid = '' AND sel = ''))"""


@query("join_merge_findings", f"""WITH {_F}, {_IDENT},
py AS (SELECT wcag_sc, status, ident, max(pos) AS pos, min(pos) AS place FROM keyed WHERE ident <> '' AND source = 'python' GROUP BY ALL),
nd AS (SELECT wcag_sc, status, ident, min(pos) AS pos, min(pos) AS place FROM keyed k WHERE ident <> '' AND source <> 'python'
  AND NOT EXISTS (SELECT 1 FROM py WHERE py.ident = k.ident AND py.status = k.status AND py.wcag_sc IS NOT DISTINCT FROM k.wcag_sc) GROUP BY ALL)
SELECT pos, 0 AS block, 0 AS other, place FROM py UNION ALL SELECT pos, 0, 1, place FROM nd
UNION ALL SELECT pos, 1, CASE WHEN source = 'python' THEN 0 ELSE 1 END, pos FROM keyed WHERE ident = ''""")
def join_merge_findings(spark, sf_dir):
    return fi.merge_findings(findings(spark, sf_dir)).select("pos", F.col("merged_pos.block").alias("block"), F.col("merged_pos.other").alias("other"), F.col("merged_pos.pos").alias("place"))


@query("agg_summary", f"WITH {_F} SELECT count(*) AS total_findings, count(*) FILTER (status = 'fail') AS violations, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'pass') AS passes FROM f")
def agg_summary(spark, sf_dir):
    return reports.summary(findings(spark, sf_dir))


@query("agg_by_severity", f"WITH {_F} SELECT d.severity, count(f.pos) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) d(severity) LEFT JOIN f ON f.severity = d.severity AND f.status <> 'pass' GROUP BY d.severity")
def agg_by_severity(spark, sf_dir):
    return reports.by_severity(findings(spark, sf_dir))


def _by(dim: str) -> str:
    return f"WITH {_F} SELECT coalesce({dim}, 'unknown') AS {dim}, count(*) FILTER (status = 'fail') AS violations, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'pass') AS passes FROM f GROUP BY 1"


for _name, _dim in (("agg_by_level", "level"), ("agg_by_sc", "wcag_sc"), ("agg_by_source", "source"), ("agg_dashboard_severity", "severity"), ("agg_dashboard_source", "source")):
    query(_name, _by(_dim))(lambda spark, sf_dir, d=_dim: reports.by_one(findings(spark, sf_dir), d))


@query("agg_dimensions", f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) FILTER (status = 'fail') AS violations, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'pass') AS passes FROM f GROUP BY 2" for d in ("level", "wcag_sc", "source")))
def agg_dimensions(spark, sf_dir):
    return reports.by_dimensions(findings(spark, sf_dir), "level", "wcag_sc", "source")


@query("agg_dashboard_levels", f"WITH {_F} SELECT d.level, count(f.pos) AS n FROM (VALUES ('A'), ('AA'), ('AAA')) d(level) LEFT JOIN f ON f.level = d.level GROUP BY d.level")
def agg_dashboard_levels(spark, sf_dir):
    n = findings(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql("SELECT explode(array('A', 'AA', 'AAA')) AS level").join(n, "level", "left").na.fill(0, ["n"])


@query("sort_status", f"WITH {_F} SELECT pos, row_number() OVER (ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'pass' THEN 2 ELSE 3 END, pos) AS place FROM f")
def sort_status(spark, sf_dir):
    return fi.placed_by_status(findings(spark, sf_dir)).select("pos", F.col("place").cast("long").alias("place"))


@query("sort_sc_numeric", f"WITH {_F} SELECT wcag_sc, CAST(row_number() OVER (ORDER BY a, b, c) AS BIGINT) AS place FROM (SELECT DISTINCT wcag_sc, coalesce(TRY_CAST(split_part(wcag_sc, '.', 1) AS INT), 999) AS a, coalesce(TRY_CAST(split_part(wcag_sc, '.', 2) AS INT), -1) AS b, coalesce(TRY_CAST(split_part(wcag_sc, '.', 3) AS INT), -1) AS c FROM f)")
def sort_sc_numeric(spark, sf_dir):
    from pyspark.sql import Window

    return findings(spark, sf_dir).select("wcag_sc").distinct().select("wcag_sc", F.row_number().over(Window.orderBy(fi.numeric_criterion(F.col("wcag_sc")))).cast("long").alias("place"))  # a row a criterion


@query("sort_facets", f"WITH {_F} SELECT severity, CAST(row_number() OVER (ORDER BY coalesce(list_position(['critical', 'high', 'medium', 'low'], severity), 99), severity) AS BIGINT) AS place FROM (SELECT DISTINCT severity FROM f WHERE severity IS NOT NULL)")
def sort_facets(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.array_position(F.array(*[F.lit(s) for s in reports.SEVERITIES]), F.col("severity"))
    return findings(spark, sf_dir).select("severity").filter("severity is not null").distinct().select("severity", F.row_number().over(Window.orderBy(F.when(rank == 0, 99).otherwise(rank), "severity")).cast("long").alias("place"))


@query("topk_criteria", f"WITH {_F} SELECT wcag_sc, count(*) AS n FROM f WHERE status = 'fail' GROUP BY wcag_sc ORDER BY n DESC, wcag_sc NULLS FIRST LIMIT 8")
def topk_criteria(spark, sf_dir):
    return reports.top_criteria(findings(spark, sf_dir))


@query("lim_paginate", f"WITH {_F} SELECT pos FROM f WHERE status = 'fail' ORDER BY pos LIMIT 50 OFFSET 50")
def lim_paginate(spark, sf_dir):
    return findings(spark, sf_dir).filter("status = 'fail'").orderBy("pos").offset(50).limit(50).select("pos")


@query("lim_caps", f"WITH {_F} SELECT page_url, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY pos) AS r FROM f) WHERE r <= 500")
def lim_caps(spark, sf_dir):
    from claraudit.operators.page_links import cap

    return cap(findings(spark, sf_dir).select("pos", F.col("element.page_url").alias("p"), F.col("element").isNull().alias("none")).join(_R.frame(spark, sf_dir).select(F.col("k").alias("pos"), "page_url"), "pos"), 500, "page_url").select("page_url", "pos")


@query("ren_cap", f"WITH {_F} SELECT wcag_sc, status, pos FROM (SELECT *, row_number() OVER (PARTITION BY wcag_sc, status ORDER BY pos) AS r FROM f) WHERE r <= 50")
def ren_cap(spark, sf_dir):
    return fi.first_per_status(findings(spark, sf_dir), 50, "wcag_sc").select("wcag_sc", "status", "pos")


@query("set_union_stages", f"WITH {_F} SELECT source, count(*) AS n FROM f WHERE source IN ('python', 'axe') GROUP BY source")
def set_union_stages(spark, sf_dir):
    f = findings(spark, sf_dir)
    stages = [f.filter(F.col("source") == s) for s in ("python", "axe")]
    return stages[0].unionByName(stages[1].drop("criterion_name"), allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_custom", f"WITH {_F} SELECT pos, CASE source WHEN 'axe' THEN 0 ELSE 1 END AS block FROM f WHERE source <> 'python'")
def set_union_custom(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.filter("source = 'axe'").select("pos", F.lit(0).alias("block")).unionByName(f.filter("source = 'custom'").select("pos", F.lit(1).alias("block")))


@query("agg_warning_counts", f"WITH {_F} SELECT rule_id AS code, count(*) AS n FROM f WHERE status <> 'pass' GROUP BY rule_id")
def agg_warning_counts(spark, sf_dir):
    return findings(spark, sf_dir).filter("status <> 'pass'").groupBy(F.col("rule_id").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_warning_samples", f"WITH {_F}, x AS (SELECT rule_id AS code, element_id AS sample, pos, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS r FROM f WHERE status <> 'pass' AND coalesce(element_id, '') <> '') SELECT c.code, c.count, coalesce(s.samples, '') AS samples FROM (SELECT rule_id AS code, count(*) AS count FROM f WHERE status <> 'pass' GROUP BY rule_id) c LEFT JOIN (SELECT code, string_agg(sample, '|' ORDER BY pos) AS samples FROM x WHERE r <= 3 GROUP BY code) s ON s.code = c.code")
def agg_warning_samples(spark, sf_dir):
    rows = findings(spark, sf_dir).filter("status <> 'pass'").select(F.col("rule_id").alias("code"), F.col("element.element_id").alias("sample"), "pos")
    return reports.samples(rows, "code", "sample", "pos")


@query("agg_step_counts", f"WITH {_F} SELECT status, count(*) AS n FROM f GROUP BY status")
def agg_step_counts(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_live_metrics", f"WITH {_F} SELECT count(*) AS n_findings, count(*) FILTER (contains(coalesce(selector, ''), ' > ')) AS n_nested, count(DISTINCT page_url) AS n_pages FROM f")
def agg_live_metrics(spark, sf_dir):
    rows = _R.frame(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.coalesce("selector", F.lit("")).contains(" > ")).alias("n_nested"), F.countDistinct("page_url").alias("n_pages"))


@query("agg_expectations", f"WITH {_F}, m AS (SELECT wcag_sc, count(*) AS n FROM f GROUP BY wcag_sc) SELECT e.wcag_sc, coalesce(m.n, 0) AS n, CASE WHEN coalesce(m.n, 0) BETWEEN e.least AND e.most THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (VALUES ('1.1.1', 1, 100000000), ('1.4.3', 0, 5), ('2.1.1', 0, 0), ('3.1.1', 1, 9)) e(wcag_sc, least, most) LEFT JOIN m ON m.wcag_sc = e.wcag_sc")
def agg_expectations(spark, sf_dir):
    asked = spark.sql("SELECT * FROM VALUES ('1.1.1', 1, 100000000), ('1.4.3', 0, 5), ('2.1.1', 0, 0), ('3.1.1', 1, 9) AS e(wcag_sc, least, most)")
    n = findings(spark, sf_dir).groupBy("wcag_sc").agg(F.count(F.lit(1)).alias("n"))
    got = F.coalesce("n", F.lit(0))
    return asked.join(n, "wcag_sc", "left").select("wcag_sc", got.alias("n"), F.when(got.between(F.col("least"), F.col("most")), "PASS").otherwise("FAIL").alias("verdict"))


@query("agg_coverage", f"WITH {_F} SELECT c.level, count(*) AS criteria, count(*) FILTER (c.wcag_sc IN (SELECT wcag_sc FROM f)) AS covered FROM cat c GROUP BY c.level")
def agg_coverage(spark, sf_dir):
    emitted = findings(spark, sf_dir).select("wcag_sc").distinct().withColumn("hit", F.lit(1))
    return catalogue(spark).join(emitted, "wcag_sc", "left").groupBy("level").agg(F.count(F.lit(1)).alias("criteria"), F.count("hit").alias("covered"))


_OVER = "('de', '1.1.1', 'Nicht-Text-Inhalt'), ('de', '1.4.3', '  '), ('ja', '1.1.1', '非テキストコンテンツ')"


@query("join_i18n_overlay", f"WITH {_F}, o AS (SELECT * FROM (VALUES {_OVER}) t(lang, wcag_sc, name)) SELECT cat.wcag_sc, coalesce(nullif(trim(o.name), ''), cat.name) AS name, count(*) AS n FROM f JOIN cat ON cat.wcag_sc = f.wcag_sc LEFT JOIN o ON o.wcag_sc = cat.wcag_sc AND o.lang = 'de' GROUP BY ALL")
def join_i18n_overlay(spark, sf_dir):
    named = overlay_names(catalogue(spark), spark.sql(f"SELECT * FROM VALUES {_OVER} AS t(lang, wcag_sc, name)"), "de").select("wcag_sc", "name")
    return findings(spark, sf_dir).select("wcag_sc").join(F.broadcast(named), "wcag_sc").groupBy("wcag_sc", "name").agg(F.count(F.lit(1)).alias("n"))


@query("join_criteria_to_rules", f"WITH {_F} SELECT wcag_sc, any_value(criterion_name) AS criterion_name, count(DISTINCT rule_id) AS rules, count(DISTINCT source) AS sources FROM f WHERE wcag_sc IS NOT NULL GROUP BY wcag_sc")
def join_criteria_to_rules(spark, sf_dir):
    return findings(spark, sf_dir).filter("wcag_sc is not null").groupBy("wcag_sc").agg(F.first("criterion_name").alias("criterion_name"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("source").alias("sources"))


@query("join_merge_axe_custom", f"WITH {_F} SELECT wcag_sc, count(*) FILTER (source = 'axe') AS axe, count(*) FILTER (source = 'custom') AS custom FROM f WHERE source <> 'python' AND wcag_sc IS NOT NULL GROUP BY wcag_sc")
def join_merge_axe_custom(spark, sf_dir):
    f = findings(spark, sf_dir).filter("wcag_sc is not null")
    sides = [f.filter(F.col("source") == s).groupBy("wcag_sc").agg(F.count(F.lit(1)).alias(s)) for s in ("axe", "custom")]
    return sides[0].join(sides[1], "wcag_sc", "full").na.fill(0)
