"""Queries of the row-level rules. Element records run through their truth tables by the keys of `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.operators import rules_policy as po
from claraudit.operators import rules_static as st
from claraudit.plans.registry import Records, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
B, BN = [True, False], [True, False, None]


def _case(*pairs: tuple[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{default}' END"


def rule(name: str, records: Records, column, cases: list[tuple[str, str]], default: str, with_sql: str = ""):
    """Registers a rule whose struct fields are joined by ':'. with_sql: more columns of the record, for the SQL only."""
    sql = f"WITH r0 AS ({records.cte()}), r AS (SELECT *{', ' + with_sql if with_sql else ''} FROM r0) SELECT k, {_case(*cases, default=default)} AS verdict FROM r"

    @query(name, sql)
    def run(spark, sf_dir):
        return records.frame(spark, sf_dir).select("k", F.concat_ws(":", *[column().getField(f).cast("string") for f in ("status", "reason")]).alias("verdict"))

    return run


def policy(name: str, records: Records, column, cases: list[tuple[str, str]], default: str, with_sql: str = ""):
    sql = f"WITH r0 AS ({records.cte()}), r AS (SELECT *{', ' + with_sql if with_sql else ''} FROM r0) SELECT k, {_case(*cases, default=default)} AS verdict FROM r"

    @query(name, sql)
    def run(spark, sf_dir):
        v = column()
        return records.frame(spark, sf_dir).select("k", F.concat_ws(":", v["status"], v["code"]).alias("verdict"))

    return run


def listed(name: str, records: Records, column, pairs: list[tuple[str, str]], with_sql: str = ""):
    sql = f"WITH r0 AS ({records.cte()}), r AS (SELECT *{', ' + with_sql if with_sql else ''} FROM r0) SELECT k, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {v!r} END' for c, v in pairs)}) AS codes FROM r"

    @query(name, sql)
    def run(spark, sf_dir):
        return records.frame(spark, sf_dir).select("k", F.array_join(column(), ",").alias("codes"))

    return run


_FORM = Records("orders", "o_orderkey", required=BN, aria_required=["true", " TRUE ", None, "false"], aria_describedby=["e1", None, ""], error_element_id=["e1", None], error_has_role_alert=B, error_has_aria_live=["assertive", "off", None])
_REQ = "(coalesce(required, false) OR lower(trim(coalesce(aria_required, ''))) = 'true') AS req, coalesce(aria_describedby, '') AS d, coalesce(error_element_id, '') AS e"
listed("rule_3_3_1", _FORM, st.error_identification, [("req AND d = ''", "no_describedby"), ("req AND d <> '' AND e = ''", "dangling_describedby"), ("e <> '' AND NOT error_has_role_alert AND coalesce(error_has_aria_live, '') NOT IN ('assertive', 'polite')", "silent_error")], _REQ)

_LABEL = Records("orders", "o_orderkey", required=[False, True], aria_required=[None, "true"], has_any_label=B, placeholder=["Name *", "", None, "Name"], label_text=["Ort", "Feld (required)", None], aria_label=[None, "必須"], type=["email", "text", "TEL"], name=["q", "user_City", None], autocomplete=[None, "on"])
listed("rule_3_3_2", _LABEL, st.labels_or_instructions, [
    ("NOT has_any_label", "no_label"),
    ("NOT req AND regexp_matches(lower(concat_ws(' ', label_text, placeholder, aria_label)), '[*]|[(]required[)]|\\brequired\\b|必須')", "required_unmarked"),
    ("NOT has_any_label AND trim(coalesce(placeholder, '')) <> ''", "placeholder_only"),
    ("(lower(type) IN ('email', 'tel', 'url', 'password', 'name') OR contains(lower(coalesce(name, '')), 'city')) AND coalesce(autocomplete, '') = ''", "no_autocomplete"),
], "(required OR lower(coalesce(aria_required, '')) = 'true') AS req")

rule("rule_2_5_8_static", Records("orders", "o_orderkey", rendered_width_px=[24.0, 23.5, 44.0, None], rendered_height_px=[24.0, 10.0, 30.0], is_inline_exception=[False, True], is_ua_controlled_exception=[False, True, None], is_offset_exception=[False, True]), st.target_size,
     [("is_inline_exception", "N/A:inline"), ("is_ua_controlled_exception", "N/A:user_agent"), ("is_offset_exception", "N/A:offset"), ("least(rendered_width_px, rendered_height_px) >= 24 AND rendered_width_px IS NOT NULL", "PASSED:")], "FAILED:small")
rule("rule_1_4_12_static", Records("orders", "o_orderkey", text_length=[19, 20, 500, None], tag=["p", "svg", "div", None], has_fixed_height=BN, has_overflow_hidden=BN), st.text_spacing,
     [("text_length < 20 OR tag = 'svg'", "N/A:not_text"), ("has_fixed_height AND has_overflow_hidden", "WARNING:fixed_and_hidden"), ("has_fixed_height", "INFO:fixed")], "PASSED:")
_MOVE = Records("orders", "o_orderkey", duration_seconds=[-1.0, None, 5.0, 5.1, 0.0], iteration_count=[None, "infinite", "3"], loops=[False, True], duration_known=B, starts_automatically=[True, False], has_mechanism=[False, True], exception=[None, "loading_indicator"])
rule("rule_2_2_2", _MOVE, st.pause_stop_hide, [
    ("exception = 'loading_indicator'", "N/A:loading"), ("NOT starts_automatically", "PASSED:not_automatic"),
    ("NOT endless AND duration_seconds IS NULL AND NOT duration_known AND has_mechanism", "PASSED:mechanism"), ("NOT endless AND duration_seconds IS NULL AND NOT duration_known", "NEEDS_REVIEW:unknown_duration"),
    ("NOT endless AND duration_seconds <= 5", "PASSED:brief"), ("has_mechanism", "PASSED:mechanism")], "FAILED:no_mechanism", "(coalesce(duration_seconds, 0) = -1 OR coalesce(iteration_count, '') = 'infinite' OR loops) AS endless")
rule("rule_2_5_3_static", Records("orders", "o_orderkey", label=["send now", "send", "***", "送信", "now"], name=["send now please", "sender", "", None, "フォーム送信", "send, now!"]), st.label_in_name, [
    ("label = '***'", "N/A:no_words"), ("trim(coalesce(name, '')) = ''", "FAILED:no_name"), ("label = '送信' AND contains(name, '送信')", "PASSED:"), ("label <> '送信' AND contains(' ' || trim(regexp_replace(regexp_replace(name, '[,!]', ' ', 'g'), ' +', ' ', 'g')) || ' ', ' ' || label || ' ')", "PASSED:")], "FAILED:not_in_name")
_IMG = Records("orders", "o_orderkey", alt=["Facebook", "", None, "logo", "Our team at work", "ok"], is_functional=B, sub_type=["social", "plain", None], classification=["decorative", "informative", "icon", "logo", "complex", "logo_with_text"], ocr_text=["team day", "", None, "sale"])
rule("rule_4_1_2", _IMG, st.image_name, [("NOT is_functional", "N/A:not_functional"), ("coalesce(alt, '') = ''", "FAILED:no_name"), ("alt = 'logo'", "FAILED:generic"), ("sub_type = 'social' AND alt = 'Facebook'", "FAILED:brand_only")], "PASSED:")
rule("rule_1_4_5", _IMG, st.images_of_text, [("classification = 'decorative'", "N/A:decorative"), ("classification = 'complex'", "PASSED:essential"), ("classification = 'logo'", "PASSED:logo"), ("classification = 'logo_with_text'", "FAILED:logo_and_text"), ("coalesce(ocr_text, '') = ''", "PASSED:no_text")], "FAILED:text")
rule("rule_1_1_1_alt", _IMG, st.alt_text, [
    ("classification = 'decorative' AND coalesce(alt, '') = ''", "PASSED:decorative"), ("classification = 'decorative'", "FAILED:decorative_named"), ("alt IS NULL", "FAILED:missing"), ("alt = ''", "FAILED:empty"),
    ("classification = 'informative' AND coalesce(ocr_text, '') <> '' AND NOT (ocr_text = 'team day' AND alt = 'Our team at work')", "FAILED:text_not_in_alt"), ("classification = 'icon' AND length(alt) < 3", "FAILED:terse")], "PASSED:")
rule("rule_1_4_11_img", Records("orders", "o_orderkey", is_ui_component=BN, boundary_ratio=[2.9, 3.0, None], edge_undecided=BN, min_region_ratio=[2.0, 4.0, None]), st.non_text_contrast,
     [("NOT coalesce(is_ui_component, false)", "N/A:not_ui"), ("boundary_ratio < 3", "FAILED:boundary"), ("edge_undecided", "INCOMPLETE:edge"), ("min_region_ratio < 3", "FAILED:region")], "PASSED:")
_META = Records("orders", "o_orderkey", alt=["x", "", None], aria_label=[None, "y"], title=[None, " "], is_decorative=BN, has_click=BN, is_focusable=BN, in_link=BN)
listed("rule_image_meta", _META, st.image_metadata, [("alt IS NULL AND NOT named AND NOT deco", "1.1.1:no_alternative"), ("deco AND named", "1.1.1:decorative_named"), ("has_click AND NOT coalesce(is_focusable, false)", "2.1.1:mouse_only"), ("in_link AND NOT named", "2.4.4:empty_link"), ("has_click AND NOT named", "4.1.2:no_name")],
       "(coalesce(alt, '') <> '' OR coalesce(aria_label, '') <> '') AS named, coalesce(is_decorative, false) AS deco")


_OVERALL = Records("orders", "o_orderkey", ok_1_1_1=BN, ok_4_1_2=BN, ok_1_4_5=BN, ok_1_4_11=BN)


@query("rule_image_overall", f"WITH r AS ({_OVERALL.cte()}) SELECT k, CASE WHEN ok_1_1_1 IS TRUE AND ok_4_1_2 IS NOT FALSE AND ok_1_4_5 IS NOT FALSE AND ok_1_4_11 IS NOT FALSE THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM r")
def rule_image_overall(spark, sf_dir):
    return _OVERALL.frame(spark, sf_dir).select("k", st.image_overall().alias("verdict"))


_MEDIA = Records("orders", "o_orderkey", src=["a.mp4", "x.m3u8?z", "live show.mp4", None], kind=["video", "audio"], muted=B, loop=B, autoplay=B, is_labelled_alternative=[False, True], is_decorative=[False, True], has_track=[False, True], link_text=["Home", "Read the Transcript", None], described_by=["short", None, "x" * 51])


@query("rule_1_2_1", f"""WITH r AS ({_MEDIA.cte()}) SELECT k, CASE WHEN src IN ('x.m3u8?z', 'live show.mp4') THEN '1:N/A' WHEN kind = 'video' AND NOT (muted AND loop AND autoplay) THEN '2:N/A'
  WHEN is_labelled_alternative THEN '3:PASSED' WHEN is_decorative THEN '4:PASSED' WHEN NOT has_track AND coalesce(link_text, '') NOT LIKE '%Transcript%' AND length(coalesce(described_by, '')) <= 50 THEN '5:FAILED' ELSE '6:NEEDS_REVIEW' END AS verdict FROM r""")
def rule_1_2_1(spark, sf_dir):
    v = st.audio_video()
    return _MEDIA.frame(spark, sf_dir).select("k", F.concat_ws(":", v["gate"].cast("string"), v["status"]).alias("verdict"))


_QUALITY = Records("orders", "o_orderkey", a=["PASSED", "FAILED", "NEEDS_REVIEW"], b=["PASSED", "FAILED", "NEEDS_REVIEW"], c=["PASSED", "NEEDS_REVIEW"])


@query("rule_quality_overall", f"WITH r AS ({_QUALITY.cte()}) SELECT k, CASE WHEN 'FAILED' IN (a, b, c) THEN 'FAILED' WHEN a = 'PASSED' AND b = 'PASSED' AND c = 'PASSED' THEN 'PASSED' ELSE 'NEEDS_REVIEW' END AS verdict FROM r")
def rule_quality_overall(spark, sf_dir):
    return _QUALITY.frame(spark, sf_dir).select("k", st.quality_overall(F.array("a", "b", "c")).alias("verdict"))


_EL = Records("orders", "o_orderkey", name=["Logo of X", "", None, "go", "image", "Our team"], kind=["decorative", "logo", "icon", "informative"], role=[None, "presentation", "img"], in_labeled_control=[False, True], tag=["img", "a", "input", "td"])
_N = "lower(trim(coalesce(name, ''))) AS n, (kind = 'decorative' OR coalesce(role, '') = 'presentation') AS deco"
_P111 = [("deco AND n = ''", "pass:decorative_valid"), ("deco", "fail:decorative_invalid"), ("in_labeled_control", "pass:functional_redundant"), ("n = ''", "fail:missing_alt")]
policy("pol_1_1_1", _EL, po.alt_text, [*_P111, ("n = 'image'", "fail:generic_alt"), ("kind = 'logo' AND n = 'logo of x'", "pass:logo_valid"), ("kind = 'logo'", "needs_review:logo_review"), ("kind = 'icon' AND length(n) < 4", "fail:icon_terse")], "pass:informative_valid", _N)
policy("pol_1_1_1_strict", _EL, lambda: po.alt_text(True), [*_P111, ("n IN ('image', 'logo of x')", "fail:generic_alt"), ("kind = 'logo'", "needs_review:logo_review"), ("kind = 'icon' AND length(n) < 4", "fail:icon_terse")], "pass:informative_valid", _N)
policy("pol_1_3_1", Records("orders", "o_orderkey", tag=["input", "select", "td"], type=["radio", "text", None], in_data_table=[False, True], section=["main", "form_region"], described_by=[None, "x"], ancestor_roles=[None, "list,group"], name=["n", None], visible_label=["", "v"]), po.relationships,
       [("in_data_table", "pass:table_context"), ("tag IN ('input', 'select') AND type = 'radio' AND section <> 'form_region' AND described_by IS NULL AND ancestor_roles IS NULL", "needs_review:orphaned_input"), ("tag IN ('input', 'select') AND name IS NULL AND visible_label = ''", "fail:missing_relationship"), ("tag <> 'td'", "pass:valid_relationship")], "not_applicable:not_applicable")
policy("pol_1_4_5", Records("orders", "o_orderkey", kind=["logo", "chart", "photo", None], video_context=[False, True], ocr_text=["Big Sale!", "abc", None], name=["big sale", "x", None]), po.images_of_text,
       [("kind IN ('logo', 'chart')", "not_applicable:exemption_applies"), ("video_context", "not_applicable:video_thumbnail_exempt"), ("ocr_text = 'Big Sale!' AND name = 'big sale'", "pass:text_matches_alt"), ("ocr_text = 'Big Sale!'", "needs_review:potential_image_of_text")], "pass:no_text_detected")
policy("pol_1_4_11", Records("orders", "o_orderkey", focusable=BN, tag=["div", "button"], kind=["icon", None], disabled=[False, True], bg=["rgba(0, 0, 0, 0)", "rgb(1, 2, 3)"], border=["rgba(0, 0, 0, 0)", "red"]), po.component_contrast,
       [("NOT coalesce(focusable, false) AND tag = 'div' AND kind IS NULL", "not_applicable:not_ui_component"), ("disabled", "pass:inactive_exempt"), ("bg LIKE '%, 0)' AND border LIKE '%, 0)'", "needs_review:no_explicit_boundary")], "needs_review:boundary_contrast_review")
policy("pol_2_4_7", Records("orders", "o_orderkey", focusable=BN, display=["none", "block", None], focus_ring=BN), po.focus_visible, [("focusable IS NOT TRUE", "not_applicable:not_focusable"), ("display = 'none'", "not_applicable:hidden_element"), ("focus_ring", "pass:focus_indicator_present")], "fail:no_focus_indicator")
policy("pol_2_4_13", Records("orders", "o_orderkey", focusable=[True, False], focus_ring=[True, False], ring_px=[0.5, 1.0, 2.0], ring_contrast=[2.9, 3.0, None]), po.focus_appearance, [("NOT focusable", "not_applicable:not_focusable"), ("NOT focus_ring", "fail:no_focus_indicator"), ("ring_px < 1 AND coalesce(ring_contrast, 0) < 3", "needs_review:thin_or_low_contrast_focus")], "pass:valid_focus_appearance")
policy("pol_2_5_3", Records("orders", "o_orderkey", visible_label=["Send!", "***", None, "送信", ""], name=["please send it", "送信する", None, "X"]), po.label_in_name,
       [("coalesce(visible_label, '') = '' OR name IS NULL", "not_applicable:no_visible_label"), ("visible_label = '***'", "not_applicable:empty_visible_label"), ("(visible_label = 'Send!' AND name = 'please send it') OR (visible_label = '送信' AND name = '送信する')", "pass:label_contained")], "fail:label_mismatch")
policy("pol_2_5_8", Records("orders", "o_orderkey", focusable=BN, tag=["a", "div"], in_paragraph=[False, True], display=["inline", "block"], w=[23.0, 24.0], h=[24.0, 30.0], spacing=[0.0, 24.0]), po.target_size,
       [("focusable IS NOT TRUE AND tag = 'div'", "not_applicable:not_interactive"), ("in_paragraph OR display = 'inline'", "pass:inline_exception"), ("w >= 24 AND h >= 24", "pass:size_meets_minimum"), ("spacing >= 24", "pass:spacing_exception")], "fail:undersized_target")

_COLORS = Records("orders", "o_orderkey", fg=["#000", "#777777", "rgb(200, 200, 200)", "#ffffff", "oops"], bg=["#fff", "rgba(0, 0, 0, 0)", "rgb(16, 32, 64)", "#808080"], font_px=[16.0, 18.66, 24.0, None], font_weight=["400", "bold", None], name=["n", None], ocr_text=[None, "t"], visible_label=[None, ""], kind=[None, "logo"], disabled=[False, True])
_HEX = {"#000": (0, 0, 0), "#777777": (119, 119, 119), "rgb(200, 200, 200)": (200, 200, 200), "#ffffff": (255, 255, 255), "oops": (0, 0, 0), "#fff": (255, 255, 255), "rgba(0, 0, 0, 0)": (0, 0, 0), "rgb(16, 32, 64)": (16, 32, 64), "#808080": (128, 128, 128)}
_RGB = ", ".join(f"('{c}', {r}, {g}, {b})" for c, (r, g, b) in _HEX.items())
_LIN = "list_transform([r, g, b], lambda v: CASE WHEN v / 255.0 <= 0.04045 THEN CAST(v AS DOUBLE) / 255 / 12.92 ELSE pow((CAST(v AS DOUBLE) / 255 + 0.055) / 1.055, 2.4) END)"
_LUM = f"lum AS (SELECT c, l[1] * 0.2126 + l[2] * 0.7152 + l[3] * 0.0722 AS l FROM (SELECT c, {_LIN} AS l FROM (VALUES {_RGB}) t(c, r, g, b)))"
_RATIO = "round((greatest(x.l, y.l) + 0.05) / (least(x.l, y.l) + 0.05), 2)"


def _contrast_sql(records: Records, normal: str, large: str, word: str) -> str:
    return f"""WITH r AS ({records.cte()}), {_LUM}, c AS (SELECT r.*, {_RATIO} AS ratio, coalesce(font_px >= 24 OR (coalesce(font_weight, '400') = 'bold' AND font_px >= 18.66), false) AS lg FROM r JOIN lum x ON x.c = r.fg JOIN lum y ON y.c = r.bg)
    SELECT k, CASE WHEN name IS NULL AND ocr_text IS NULL THEN 'not_applicable:no_text' WHEN kind = 'logo' OR disabled THEN 'pass:contrast_exempt' WHEN bg LIKE 'rgba%' THEN 'needs_review:transparent_bg'
    WHEN ratio >= CASE WHEN lg THEN {large} ELSE {normal} END THEN 'pass:{word}sufficient' ELSE 'fail:{word}insufficient' END AS verdict, ratio FROM c"""


for _name, _level, _sql in (("pol_1_4_3", "AA", _contrast_sql(_COLORS, "4.5", "3.0", "contrast_")), ("pol_1_4_6", "AAA", _contrast_sql(_COLORS, "7.0", "4.5", "contrast_enhanced_"))):

    @query(_name, _sql)
    def _contrast(spark, sf_dir, level=_level):
        v = po.text_contrast(level)
        return _COLORS.frame(spark, sf_dir).select("k", F.concat_ws(":", v["status"], v["code"]).alias("verdict"), v["ratio"].alias("ratio"))


_SECTION = Records("orders", "o_orderkey", t1=["div", "nav", "li"], r1=["", "Search", "x"], t2=["main", "p"], r2=["", "dialog"], t3=["FOOTER", "span"])


@query("pol_section", f"""WITH r AS ({_SECTION.cte()}) SELECT k, CASE WHEN r1 = 'Search' THEN 'form_region' WHEN t1 = 'nav' THEN 'navigation' WHEN r2 = 'dialog' THEN 'modal_dialog' WHEN t2 = 'main' THEN 'main_content' WHEN t3 = 'FOOTER' THEN 'footer' ELSE 'unknown' END AS section FROM r""")
def pol_section(spark, sf_dir):
    return _SECTION.frame(spark, sf_dir).select("k", po.section(F.array("t1", "t2", "t3"), F.array("r1", "r2", F.lit(""))).alias("section"))


_APPLY = Records("orders", "o_orderkey", tag=["img", "a", "div", "svg"], role=[None, "img", "tab"], focusable=BN, name=[None, "n"], ocr_text=[None, "t"], visible_label=[None, ""])


@query("flt_applicable", f"""WITH r AS ({_APPLY.cte()}), x AS (SELECT k, unnest(['1.1.1', '1.4.5', '1.3.1', '1.4.11', '2.4.7', '2.4.13', '2.5.3', '2.5.8', '1.4.3', '1.4.6']) AS sc, tag, coalesce(role, '') AS role, coalesce(focusable, false) AS f, name IS NOT NULL OR ocr_text IS NOT NULL AS words FROM r)
SELECT k, sc FROM x WHERE CASE WHEN sc IN ('1.1.1', '1.4.5') THEN tag IN ('img', 'svg') OR role = 'img' WHEN sc IN ('1.4.3', '1.4.6') THEN words ELSE tag = 'a' OR role = 'tab' OR f END""")
def flt_applicable(spark, sf_dir):
    return _APPLY.frame(spark, sf_dir).select("k", F.explode(po.applicable()).alias("sc"))


@query("flt_not_applicable", f"WITH r AS ({_APPLY.cte()}) SELECT k, 'pass' AS status FROM r WHERE name IS NOT NULL")
def flt_not_applicable(spark, sf_dir):
    v = st.cases((F.col("name").isNotNull(), "pass"), default="not_applicable")
    return _APPLY.frame(spark, sf_dir).select("k", v.alias("status")).filter("status <> 'not_applicable'")


@query("pol_format", f"WITH r AS ({_OVERALL.cte()}) SELECT k, 'python_pipeline' AS source, CASE WHEN ok_1_1_1 THEN 'pass' WHEN ok_1_1_1 IS NULL THEN 'needs_review' ELSE 'fail' END AS status, CASE WHEN ok_1_1_1 IS NULL THEN 0.8 ELSE 1.0 END AS confidence_score FROM r")
def pol_format(spark, sf_dir):
    ok = F.col("ok_1_1_1")
    return _OVERALL.frame(spark, sf_dir).select("k", F.lit("python_pipeline").alias("source"), st.cases((ok, "pass"), (ok.isNull(), "needs_review"), default="fail").alias("status"), F.when(ok.isNull(), 0.8).otherwise(1.0).alias("confidence_score"))
