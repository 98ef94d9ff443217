"""The audit plan end to end over fixture tables."""

from pyspark.sql import functions as F

from claraudit.plans import audit as au
from tests.conftest import DATA


def test_audit(spark):
    sizes = spark.createDataFrame([("http://p/", "#a", 10.0, 30.0, False, False, False), ("http://p/", "#b", 24.0, 24.0, False, False, False), ("http://p/", "#c", 1.0, 1.0, True, False, False)], "page_url string, selector string, rendered_width_px double, rendered_height_px double, is_inline_exception boolean, is_ua_controlled_exception boolean, is_offset_exception boolean")
    scanner = spark.createDataFrame([("axe", "target-size", "2.5.8", "fail", "scanner", "medium", "http://p/", "#a"), ("axe", "x", "1.4.6", "fail", "AAA", None, "http://p/", "#a")], "source string, rule_id string, wcag_sc string, status string, reason string, severity string, page_url string, selector string")
    report = au.audit(spark, {"target_size": sizes, "pages": spark.read.parquet(f"{DATA}/pages.parquet")}, scanner=scanner)
    two = {(r.source, r.status, r.element.selector) for r in report.findings.filter("wcag_sc = '2.5.8'").collect()}
    assert two == {("python", "fail", "#a"), ("python", "pass", "#b")}
    assert report.findings.filter("level = 'AAA'").isEmpty()
    total = report.summary.first()
    assert total.total_findings == total.violations + total.needs_review + total.passes == report.by_dimension.filter("dimension = 'source'").agg(F.sum(F.col("violations") + F.col("needs_review") + F.col("passes"))).first()[0]
    assert ("error_identification", "no table form_field") in report.warnings


def test_one_criterion_plans_one_rule(spark):
    report = au.audit(spark, {"pages": spark.read.parquet(f"{DATA}/pages.parquet")}, au.AuditConfig(level="AAA", criteria=("2.4.9",)))
    assert {r.rule_id for r in report.findings.select("rule_id").distinct().collect()} == {"link_purpose"} and not report.warnings


def test_user_rule(spark):
    @au.rule("has_title", "2.4.2", "pages")
    def has_title(pages):
        return pages.select(F.col("url").alias("page_url"), F.when(F.col("html").contains("<title>"), "PASSED").otherwise("FAILED").alias("status"), F.lit("").alias("reason"))

    try:
        report = au.audit(spark, {"pages": spark.read.parquet(f"{DATA}/pages.parquet")}, au.AuditConfig(criteria=("2.4.2",)))
        assert report.findings.filter("rule_id = 'has_title'").count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    finally:
        del au.RULES["has_title"]


def test_failing_rule_is_isolated(spark, tmp_path):
    @au.rule("breaks", "2.4.2", "pages")
    def breaks(pages):
        return pages.select(F.col("url").alias("page_url"), F.raise_error(F.lit("no")).cast("string").alias("status"))

    try:
        report = au.audit(spark, {"pages": spark.read.parquet(f"{DATA}/pages.parquet")}, au.AuditConfig(level="AAA", criteria=("2.4.2", "2.4.8"), isolate=str(tmp_path)))
        found = report.findings.collect()
        assert [r.status for r in found if r.rule_id == "breaks"] == ["needs_review"] and any(r.rule_id == "location" for r in found)
        assert [w[0] for w in report.warnings] == ["breaks"]
    finally:
        del au.RULES["breaks"]


def test_rules_of_one_table_share_a_scan(spark):
    report = au.audit(spark, {"pages": spark.read.parquet(f"{DATA}/pages.parquet")}, au.AuditConfig(level="AAA"))
    plan = report.findings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1


def test_pages_of_one_address_stay_apart(spark):
    html = "<html lang='en'><body><a href='/x'>here</a></body></html>"
    pages = spark.createDataFrame([(1, "http://p/", html), (2, "http://p/", html), (3, "http://q/", html)], "page_id long, url string, html string")
    scanner = spark.createDataFrame([("axe", "link", "2.4.9", "fail", "scanner", "medium", u, "a:1") for u in ("http://p/", "http://r/")], "source string, rule_id string, wcag_sc string, status string, reason string, severity string, page_url string, selector string")
    found = au.audit(spark, {"pages": pages}, au.AuditConfig(level="AAA", criteria=("2.4.9", "2.4.8")), scanner=scanner).findings.collect()
    links = sorted((r.source, r.page_id or "", r.element.page_url) for r in found if r.wcag_sc == "2.4.9")
    assert links == [("axe", "", "http://r/"), ("python", "1", "http://p/"), ("python", "2", "http://p/"), ("python", "3", "http://q/")]
    assert sorted(r.page_id for r in found if r.wcag_sc == "2.4.8") == ["1", "2", "3"]


def test_rules_over_raw_pages_keep_pages_of_one_address(spark):
    from claraudit.plans.extract import page_tables

    html = "<form><label for='n'>Name</label><input id='n' autocomplete='name' required></form><audio src='a.mp3'></audio><b draggable='true'>x</b>"
    tables = page_tables(spark.createDataFrame([(1, "http://p/", html), (2, "http://p/", html)], "page_id long, url string, html string"))
    report = au.audit(spark, tables, au.AuditConfig(level="AAA", criteria=("1.3.2", "3.3.1", "2.5.7", "1.2.1")))
    got = {(r.value, r.n) for r in report.by_dimension.filter("dimension = 'wcag_sc'").selectExpr("value", "violations + needs_review + passes AS n").collect()}
    assert got == {(c, 2) for c in ("1.3.2", "3.3.1", "2.5.7", "1.2.1")}


def test_findings_without_page_meet_by_address(spark):
    from claraudit.operators import findings as fi

    kind = "source string, page_id string, pos long, wcag_sc string, status string, element struct<html:string,element_id:string,tag:string,target:array<string>,selector:string,element_ref_id:string,frame_path:string,page_url:string>"
    about = lambda url: (None, None, None, None, "#a", None, None, url)
    rows = [("python", "1", 1, "x", "fail", about("p")), ("python", "1", 2, "x", "fail", about("p")), ("python", "2", 3, "x", "fail", about("p")), ("python", None, 4, "x", "fail", about("p")), ("axe", None, 5, "x", "fail", about("p"))]
    rows += [("python", None, 6, "x", "fail", about("q")), ("axe", "3", 7, "x", "fail", about("q")), ("axe", "4", 8, "x", "fail", about("r")), ("axe", None, 9, "x", "fail", about("r"))]
    got = {(r.source, r.page_id, r.pos, r.merged_pos.pos) for r in fi.merge_findings(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("python", "1", 2, 1), ("python", "2", 3, 3), ("python", None, 6, 6), ("axe", "4", 8, 8)}


def test_all_links_of_a_page_are_judged(spark):
    page = "".join(f"<a href='/{i}'>link {i}</a>" for i in range(2500)) + "<a href='/last'>here</a>"
    pages = spark.createDataFrame([(1, "http://p/", page)], "page_id long, url string, html string")
    report = au.audit(spark, {"pages": pages}, au.AuditConfig(level="AAA", criteria=("2.4.9",)))
    total = report.summary.first()
    assert (total.violations, total.passes) == (1, 2500)
