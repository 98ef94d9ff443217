"""The audit as one lazy plan: rules chosen by criterion before anything is read, one scan of each table for all rules that
are expressions over its rows, one union, merged with a scanner's findings and reported. User rules join in by @rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.operators import boxes, checks, findings, form_checks, page_links, rendered, reports, rules_policy, rules_static, sensory
from claraudit.operators import transcripts as tr
from claraudit.sources.catalogue import catalogue


@dataclass(frozen=True)
class Rule:
    """One criterion's rule. verdicts: array<struct<selector, status, reason>> of a row of `table`; rules of one table share
    a scan. evaluate: for rules that need more than a row, DataFrames of `tables` to rows with status."""

    rule_id: str
    wcag_sc: str
    tables: tuple[str, ...]
    verdicts: Callable[[], Column] | None = None
    evaluate: Callable[..., DataFrame] | None = None


RULES: dict[str, Rule] = {}


def rule(rule_id: str, wcag_sc: str, *tables: str) -> Callable:
    """Registers a function of DataFrames, one for each table, to a DataFrame with status (and reason, page_url ...)."""

    def take(f: Callable[..., DataFrame]) -> Callable:
        RULES[rule_id] = Rule(rule_id, wcag_sc, tables, evaluate=f)
        return f

    return take


def row_rule(rule_id: str, wcag_sc: str, table: str, status: Callable[[], Column], reason: Callable[[Column], Column] | None = None, of: Callable[[Column], Column] = lambda v: v) -> None:
    """Registers a rule that is one expression over a row. of: its status; reason: its reason."""

    def verdicts() -> Column:
        v = status()
        text = F.lit("") if reason is None else reason(v)
        return F.array(F.struct(F.lit(None).cast("string").alias("selector"), of(v).alias("status"), text.cast("string").alias("reason")))

    RULES[rule_id] = Rule(rule_id, wcag_sc, (table,), verdicts=verdicts)


def column_rule(rule_id: str, wcag_sc: str, table: str, verdict: Callable[[], Column], reason: str = "reason") -> None:
    """A rule that is one struct(status, reason) expression."""
    row_rule(rule_id, wcag_sc, table, verdict, lambda v: v[reason], lambda v: v["status"])


def violation_rule(rule_id: str, wcag_sc: str, table: str, codes: Callable[[], Column]) -> None:
    """A rule that lists violation codes."""
    row_rule(rule_id, wcag_sc, table, codes, lambda v: F.array_join(v, " | "), rules_static.status_of_violations)


C = F.col
violation_rule("error_identification", "3.3.1", "form_field", rules_static.error_identification)
violation_rule("labels_or_instructions", "3.3.2", "form_field", rules_static.labels_or_instructions)
column_rule("target_size", "2.5.8", "target_size", rules_static.target_size)
column_rule("text_spacing", "1.4.12", "text_spacing", rules_static.text_spacing)
column_rule("pause_stop_hide", "2.2.2", "moving_content", rules_static.pause_stop_hide)
column_rule("label_in_name", "2.5.3", "interactive", rules_static.label_in_name)
column_rule("alt_text", "1.1.1", "image", rules_static.alt_text)
column_rule("image_name", "4.1.2", "image", rules_static.image_name)
column_rule("images_of_text", "1.4.5", "image", rules_static.images_of_text)
column_rule("non_text_contrast", "1.4.11", "image", rules_static.non_text_contrast)
column_rule("audio_video", "1.2.1", "media", rules_static.audio_video, "gate")
# policies over semantic element records
for _id, _sc, _f in (
    ("policy_alt_text", "1.1.1", rules_policy.alt_text), ("policy_relationships", "1.3.1", rules_policy.relationships), ("policy_contrast", "1.4.3", rules_policy.text_contrast),
    ("policy_contrast_enhanced", "1.4.6", lambda: rules_policy.text_contrast("AAA")), ("policy_images_of_text", "1.4.5", rules_policy.images_of_text), ("policy_component_contrast", "1.4.11", rules_policy.component_contrast),
    ("policy_focus_visible", "2.4.7", rules_policy.focus_visible), ("policy_focus_appearance", "2.4.13", rules_policy.focus_appearance), ("policy_label_in_name", "2.5.3", rules_policy.label_in_name), ("policy_target_size", "2.5.8", rules_policy.target_size),
):
    column_rule(_id, _sc, "element", _f, "code")
# checks of forms, links, handlers and styles
row_rule("error_suggestion", "3.3.3", "error_message", lambda: form_checks.error_suggestion(C("message")), lambda v: C("message"))
column_rule("error_prevention", "3.3.4", "form", lambda: form_checks.error_prevention(C("words"), C("safeguard")), "kind")
row_rule("image_text_score", "1.4.5", "page_image", form_checks.images_of_text)
row_rule("use_of_color", "1.4.1", "link_style", form_checks.use_of_color)
row_rule("status_messages", "4.1.3", "live_region", form_checks.status_messages)
violation_rule("accessible_auth", "3.3.8", "auth_form", form_checks.accessible_auth)
row_rule("char_keys", "2.1.4", "handler", form_checks.char_keys)
row_rule("pointer_cancel", "2.5.2", "handler", form_checks.pointer_cancel)
row_rule("dragging", "2.5.7", "handler", form_checks.dragging)
row_rule("focus_change", "2.4.7", "focus_style", form_checks.focus_change)
violation_rule("focus_indicator", "2.4.13", "focus_style", form_checks.focus_indicator)
row_rule("meaningful_sequence", "1.3.2", "visual_order", lambda: form_checks.meaningful_sequence(C("positions")))
row_rule("audio_transcript", "1.2.1", "page_audio", form_checks.audio_transcript)
row_rule("transcript_sounds", "1.2.1", "transcript", lambda: tr.sound_status(C("text")))
row_rule("transcript_speakers", "1.2.1", "transcript", lambda: tr.speaker_status(tr.speaker_labels(C("text")), C("segments")))
# raw pages
for _id, _sc, _f in (("location", "2.4.8", checks.location_status), ("multiple_ways", "2.4.5", checks.multiple_ways_status), ("consistent_help", "3.2.6", checks.consistent_help_status), ("pronunciation", "3.1.6", checks.pronunciation_status), ("html_parsing", "4.1.1", checks.parsing_status)):
    row_rule(_id, _sc, "pages", _f)


def _link_verdicts() -> Column:
    """All links of a page that have a text."""
    one = lambda x, i: F.struct(F.concat(F.lit("a:"), i + 1).alias("selector"), F.when(checks.is_generic(x["text"]), "FAILED").otherwise("PASSED").alias("status"), x["text"].alias("reason"))
    return F.filter(F.transform(page_links.link_array(), one), lambda v: v["reason"] != "")


RULES["link_purpose"] = Rule("link_purpose", "2.4.9", ("pages",), verdicts=_link_verdicts)


@rule("sensory", "1.3.3", "text_block")
def _sensory(rows: DataFrame) -> DataFrame:
    return sensory.findings(rows).withColumn("reason", C("sentence"))


def _of_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Snapshot rows, whose pages are numbers, with their addresses."""
    key = C("key").cast("string").alias("element_id") if "key" in rows.columns else F.lit(None).cast("string").alias("element_id")
    return rows.join(pages.select("page", "page_url").distinct(), "page").select(C("page").alias("page_id"), "page_url", key, "status", F.lit("").alias("reason"))


for _id, _sc, _f in (("resize_text", "1.4.4", rendered.resize_text), ("rendered_text_spacing", "1.4.12", rendered.text_spacing), ("reflow", "1.4.10", rendered.reflow)):
    rule(_id, _sc, "rendered_element", "rendered_page")(lambda e, p, f=_f: _of_page(f(e, p), p))
rule("orientation", "1.3.4", "rendered_element", "orientation_page")(lambda e, p: _of_page(rendered.orientation(e, p).withColumn("status", F.when(C("codes") == "", "PASSED").otherwise("FAILED")), p))
rule("hover_content", "1.4.13", "hover")(lambda rows: rendered.hover_content(rows).withColumn("reason", F.lit("")))
for _id, _sc, _limits in (("focus_obscured", "2.4.11", (0.95, 0.10)), ("focus_obscured_enhanced", "2.4.12", (0.10, 0.02))):
    rule(_id, _sc, "focus_box", "overlay_box", "rendered_page")(lambda f, o, p, x=_limits: _of_page(boxes.focus_not_obscured(boxes.obscuration(f, o), p, *x).withColumnRenamed("id", "key"), p))

# The statuses of rules and those of findings; rows of any other status give no finding.
OUTCOMES = {"FAILED": "fail", "FAIL": "fail", "fail": "fail", "PASSED": "pass", "PASS": "pass", "pass": "pass", "NEEDS_REVIEW": "needs_review", "REVIEW": "needs_review", "INCOMPLETE": "needs_review", "incomplete": "needs_review", "needs_review": "needs_review", "WARNING": "needs_review", "INFO": "needs_review"}
ELEMENT = ("page_url", "selector", "element_id", "tag", "html", "element_ref_id", "frame_path")


@dataclass(frozen=True)
class AuditConfig:
    """isolate: a folder; each rule that isn't an expression then writes its findings there first, and one that fails while
    it runs becomes a finding to review and a warning instead of stopping the report."""

    level: str = "AA"
    lang: str = "en"
    criteria: tuple[str, ...] = ()
    disabled: frozenset[str] = frozenset()
    isolate: str | None = None


@dataclass
class Report:
    findings: DataFrame
    summary: DataFrame
    by_severity: DataFrame
    by_dimension: DataFrame
    warnings: list[tuple[str, str]] = field(default_factory=list)


def _records(rows: DataFrame, number: Column, values: dict[str, Column], source: str) -> DataFrame:
    """Rows to records of findings; what doesn't apply is left out. pos follows the rule, then the element, whatever the
    partitioning: it decides which of two findings about one element wins. page_id tells pages of one address apart."""
    have = set(rows.columns)
    text = {c: (C(c) if c in have else C("url") if c == "page_url" and "url" in have else F.lit(None)).cast("string") for c in (*ELEMENT, "page_id")} | values
    status = findings.case_map(text.pop("status"), OUTCOMES)
    out = rows.select(F.lit(source).alias("source"), number.cast("long").alias("_number"), status.alias("status"), *[v.alias(k) for k, v in text.items()]).filter("status is not null")
    place = F.pmod(F.xxhash64("page_url", "selector", "element_id", "reason", "html", "frame_path", "page_id"), F.lit(1 << 40))
    return out.withColumn("pos", C("_number") * (1 << 40) + place).drop("_number")


def convert(rows: DataFrame, r: Rule, severity: str | None, source: str = "python", number: int = 0) -> DataFrame:
    """Rows with status (and reason) to records of findings."""
    reason = C("reason").cast("string") if "reason" in rows.columns else F.lit("")
    return _records(rows, F.lit(number), {"rule_id": F.lit(r.rule_id), "wcag_sc": F.lit(r.wcag_sc), "severity": F.lit(severity).cast("string"), "reason": reason, "status": C("status")}, source)


def _tagged(r: Rule, number: int, severity: str | None) -> Column:
    tag = [F.lit(number).alias("number"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.wcag_sc).alias("wcag_sc"), F.lit(severity).cast("string").alias("severity")]
    return F.transform(r.verdicts(), lambda v: F.struct(*tag, v["selector"].alias("selector"), v["status"].alias("status"), v["reason"].alias("reason")))


def verdicts(rows: DataFrame, tagged: Sequence[Column], source: str = "python") -> DataFrame:
    """Records of all expression rules of one table, in one scan of it."""
    kept = [c for c in (*ELEMENT, "url", "page_id") if c in rows.columns]
    rows = rows.select(*kept, F.explode(F.concat(*tagged)).alias("_v"))
    own = C("_v.selector") if "selector" not in kept else F.coalesce("_v.selector", "selector")
    return _records(rows, C("_v.number"), {"selector": own, **{c: C(f"_v.{c}") for c in ("rule_id", "wcag_sc", "severity", "reason", "status")}}, source)


def _source(name: str, rows: DataFrame) -> DataFrame:
    """What expression rules of a table read: of raw pages the shown markup and its tags, made once for all of them."""
    return page_links.prepared(rows) if name == "pages" else rows


def audit(spark: SparkSession, tables: dict[str, DataFrame], config: AuditConfig | None = None, scanner: DataFrame | None = None) -> Report:
    """Findings and aggregates, all lazy but for isolated rules. A rule whose table is missing or whose plan can't be built
    becomes a warning."""
    config = config or AuditConfig()
    known = catalogue(spark, config.lang)
    severity = {r["wcag_sc"]: r["severity"] for r in known.collect()}
    parts, warnings, shared = [], [], {}
    for number, r in enumerate(RULES.values()):
        if r.rule_id in config.disabled or (config.criteria and r.wcag_sc not in config.criteria):
            continue
        if missing := [t for t in r.tables if t not in tables]:
            warnings.append((r.rule_id, f"no table {missing[0]}"))
            continue
        own = [tables[t] for t in r.tables]
        try:
            if r.verdicts is not None:
                tagged = _tagged(r, number, severity.get(r.wcag_sc))
                _source(r.tables[0], own[0]).select(tagged)  # plans it, so that a missing column is known here
                shared.setdefault(r.tables[0], []).append(tagged)
                continue
            part = convert(r.evaluate(*own), r, severity.get(r.wcag_sc), number=number)
            if config.isolate:
                part.write.mode("overwrite").parquet(f"{config.isolate}/{r.rule_id}")
                part = spark.read.schema(part.schema).parquet(f"{config.isolate}/{r.rule_id}")
            parts.append(part)
        except Exception as error:  # noqa: BLE001  one rule must not stop the others
            warnings.append((r.rule_id, str(error)[:300]))
            failed = spark.createDataFrame([("needs_review", f"the rule failed: {str(error)[:300]}")], "status string, reason string")
            parts.append(convert(failed, r, severity.get(r.wcag_sc), number=number))
    parts = [verdicts(_source(t, tables[t]), tagged) for t, tagged in shared.items()] + parts
    if scanner is not None:
        own = scanner.filter(C("wcag_sc").isin(*config.criteria)) if config.criteria else scanner
        place = F.pmod(F.xxhash64(*[c for c in own.columns if own.schema[c].dataType.simpleString() in ("string", "int", "bigint")]), F.lit(1 << 40))
        own = own.withColumn("page_id", C("page_id").cast("string")) if "page_id" in own.columns else own
        parts.append(own if "pos" in own.columns else own.withColumn("pos", F.lit(len(RULES) << 40) + place))
    if not parts:
        raise ValueError(f"nothing to audit: {warnings}")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    made = findings.make_findings(union, known)
    merged = findings.merge_findings(findings.filter_level(made, config.level))
    return Report(merged, reports.summary(merged), reports.by_severity(merged), reports.by_dimensions(merged, "level", "wcag_sc", "source"), warnings)
