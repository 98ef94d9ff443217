"""The findings table: making, filtering, merging, ordering and limiting findings.

A finding is (source, rule_id, wcag_sc, status, reason, severity, pos) and an element struct; pos is its place in its
source's stream, carried because order decides ties and Spark keeps none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import text

STATUS_ORDER = {"fail": 0, "needs_review": 1, "pass": 2}
LEVELS = {"A": ("A",), "AA": ("A", "AA"), "AAA": ("A", "AA", "AAA")}
# Impacts of scanners and the severities they mean.
IMPACT_SEVERITY = {"critical": "critical", "serious": "high", "moderate": "medium", "minor": "low"}
# Raw statuses and the ones findings have; any other means needs_review.
STATUS_MAP = {"fail": "fail", "failed": "fail", "violation": "fail", "pass": "pass", "passed": "pass", "incomplete": "needs_review", "needs_review": "needs_review", "warning": "needs_review", "info": "needs_review"}
ELEMENT = ("html", "element_id", "tag", "target", "selector", "element_ref_id", "frame_path", "image_src", "image_reference", "image_text", "page_url")


def case_map(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def status_of(raw: Column) -> Column:
    return case_map(F.lower(raw), STATUS_MAP, F.lit("needs_review"))


def status_rank(c: Column) -> Column:
    return F.coalesce(case_map(c, {k: str(v) for k, v in STATUS_ORDER.items()}).cast("int"), F.lit(3))


def make_findings(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Records with flat element columns to findings: name and level of the catalogue, no severity on a pass, markup of at
    most 600 characters, and no element for a pass that names none."""
    have = set(records.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("array<string>" if c == "target" else "string")
    passed = F.col("status") == "pass"
    target = F.coalesce(col("target"), F.when(F.coalesce("selector", F.lit("")) != "", F.array("selector"))) if "selector" in have else col("target")
    fields = {c: col(c) for c in ELEMENT} | {"target": target, "html": F.substring(F.coalesce(col("html"), F.lit("")), 1, 600)}
    filled = F.coalesce(*[text.blank_to_null(col(c)) for c in ("html", "element_id", "tag", "element_ref_id", "frame_path", "image_src", "image_reference")], text.blank_to_null(F.array_join(target, ""))).isNotNull()
    element = F.when(~passed | filled, F.struct(*[v.alias(k) for k, v in fields.items()]))
    rows = records.withColumn("element", element).withColumn("severity", F.when(~passed, F.col("severity")))
    names = F.broadcast(catalogue.select("wcag_sc", "level", F.col("name").alias("criterion_name")))  # 87 rows
    keep = [c for c in records.columns if c not in ELEMENT]
    return rows.join(names, "wcag_sc", "left").select(*keep, "level", "criterion_name", "element")


def filter_level(findings: DataFrame, level: str) -> DataFrame:
    """A; AA also A; AAA all three. Findings without a level stay."""
    return findings.filter(F.col("level").isin(*LEVELS[level]) | F.col("level").isNull())


def filter_facets(findings: DataFrame, facets: dict[str, list[str]], needle: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Every facet's value is one of its list (an empty list asks nothing), and some column contains the needle."""
    keep = F.lit(True)
    for c, values in facets.items():
        if values:
            keep = keep & F.col(c).isin(*values)
    if needle:
        some = F.lit(False)
        for c in columns:
            some = some | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower())
        keep = keep & some
    return findings.filter(keep)


def identity(element: str = "element") -> Column:
    """What a finding is about: its selector, targets, reference, id or markup, the first that is there, with page and frame;
    empty if none."""
    get = lambda c: F.coalesce(F.lower(F.trim(F.col(f"{element}.{c}"))), F.lit(""))
    scope = F.array_join(F.filter(F.array(get("page_url"), get("frame_path")), lambda x: x != ""), "|")
    selector = F.coalesce(F.lower(text.collapse(F.col(f"{element}.selector"))), F.lit(""))
    target, markup = text.target_signature(F.col(f"{element}.target")), text.html_signature(F.col(f"{element}.html"))
    cases = [("sel", selector, F.lit("")), ("target", target, F.lit("")), ("ref", get("element_ref_id"), F.lit("")), ("id", get("element_id"), F.concat(get("tag"), F.lit("|"))), ("html", markup, F.concat(get("tag"), F.lit("|")))]
    out = F.lit("")
    for name, value, before in reversed(cases):
        out = F.when(value != "", F.concat(F.lit(name + ":"), scope, F.lit("|"), before, value)).otherwise(out)
    return out


def _met_by_address(rows: DataFrame, by: list[str]) -> DataFrame:
    """A finding without page_id speaks of every page of its address: it goes where one with page_id is of a source that is no
    worse, and those of a worse source go where it stands."""
    w, bare = Window.partitionBy(*by), F.col("page_id").isNull()
    paged, unpaged = (F.min(F.when(c, F.col("_other"))).over(w) for c in (~bare, bare))
    stays = F.when(bare, F.coalesce(paged > F.col("_other"), F.lit(True))).otherwise(F.coalesce(unpaged >= F.col("_other"), F.lit(True)))
    return rows.withColumn("_stays", stays).filter("_stays").drop("_stays")


def merge_findings(findings: DataFrame, first: str = "python") -> DataFrame:
    """One finding for each (criterion, status, identity), and page where page_id is a column: pages can share an address. Of
    the preferred source the last one wins, at the place of the first; of the others the first one, where the preferred has
    none. Findings without identity all stay, behind the rest. Adds merged_pos, which orders the result."""
    rows = findings.withColumn("_key", identity()).withColumn("_other", (F.col("source") != first).cast("int"))
    # one without identity is a group of its own: a single pass, and no group grows with their number
    rows = rows.withColumn("_own", F.when(F.col("_key") == "", F.monotonically_increasing_id()))
    by = ["wcag_sc", "status", "_key", "_own"]
    if "page_id" in findings.columns:
        rows, by = _met_by_address(rows, by), [*by, "page_id"]
    w = Window.partitionBy(*by)
    pick = w.orderBy("_other", F.when(F.col("_other") == 0, -F.col("pos")).otherwise(F.col("pos")))
    place = F.min(F.struct("_other", "pos")).over(w)
    kept = rows.withColumn("_r", F.row_number().over(pick)).withColumn("_p", place).filter("_r = 1")
    block = F.when(F.col("_own").isNull(), 0).otherwise(1)
    return kept.withColumn("merged_pos", F.struct(block.alias("block"), F.col("_p._other").alias("other"), F.col("_p.pos").alias("pos"))).drop("_r", "_p", "_key", "_other", "_own")


def order_by_status(findings: DataFrame) -> DataFrame:
    """Fail, needs_review, pass, others; by place within."""
    return findings.orderBy(status_rank(F.col("status")), "pos")


def placed_by_status(findings: DataFrame, rows: int = 100_000) -> DataFrame:
    """Each finding with its place (from 1) in that order. Ranges of pos of about `rows` findings are ordered by themselves
    and follow the counts of those before them, so no task orders the table."""
    facts = findings.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, ((facts["high"] or 0) - (facts["low"] or 0)) // max(1, facts["n"] // rows) + 1)
    ranked = findings.withColumn("_r", status_rank(F.col("status"))).withColumn("_b", F.floor((F.col("pos") - (facts["low"] or 0)) / width))
    counts = ranked.groupBy("_r", "_b").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_r", "_b", (F.sum("_n").over(Window.orderBy("_r", "_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r", "_b").orderBy("pos"))
    return ranked.withColumn("_i", inside).join(F.broadcast(before), ["_r", "_b"]).withColumn("place", F.col("_before") + F.col("_i")).drop("_r", "_b", "_before", "_i")


def first_per_status(findings: DataFrame, most: int, *by: str) -> DataFrame:
    """The first `most` findings of each status (of each group)."""
    w = Window.partitionBy(*by, "status").orderBy("pos")
    return findings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def numeric_criterion(c: Column) -> Column:
    """Parts of a criterion as numbers, for ordering; (999) for what isn't one."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(F.lit(999))).otherwise(parts)
