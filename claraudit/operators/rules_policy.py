"""Policies of the element pipeline: (status, code) by ordered conditions on an element's context columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claraudit.functions import color
from claraudit.operators.rules_static import cases, filled, yes

C = F.col
PASS, FAIL, REVIEW, NA = "pass", "fail", "needs_review", "not_applicable"
# Alternatives that say nothing.
GENERIC_ALT = ("image", "picture", "photo", "icon", "graphic", "spacer", "logo")
LOGO_WORDS = ("logo", "brand", "home", "ロゴ", "ブランド", "ホーム")
# Landmark roles and tags, and the sections they mean.
LANDMARKS = {"header": "header", "banner": "header", "footer": "footer", "contentinfo": "footer", "nav": "navigation", "navigation": "navigation", "main": "main_content", "form": "form_region", "search": "form_region", "table": "data_table", "grid": "data_table", "dialog": "modal_dialog", "alertdialog": "modal_dialog", "article": "article_card"}


def _decide(*pairs: tuple[Column, tuple[str, str]], default: tuple[str, str]) -> Column:
    s = lambda v: F.struct(F.lit(v[0]).alias("status"), F.lit(v[1]).alias("code"))
    return cases(*[(c, s(v)) for c, v in pairs], default=s(default))


def _any_contains(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def alt_text(strict: bool = False) -> Column:
    """1.1.1. strict: a generic word anywhere fails; otherwise the whole alternative has to be one."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    generic = _any_contains(name, GENERIC_ALT) if strict else name.isin(*GENERIC_ALT)
    decorative = yes(C("kind") == "decorative") | yes(C("role").isin("presentation", "none"))
    poor = (F.length(name) < 4) | ~name.rlike(r"[a-z]{2}|[^\x00-\x7F]")
    return _decide(
        (decorative & (name == ""), (PASS, "decorative_valid")),
        (decorative, (FAIL, "decorative_invalid")),
        (yes("in_labeled_control"), (PASS, "functional_redundant")),
        (name == "", (FAIL, "missing_alt")),
        (generic, (FAIL, "generic_alt")),
        (yes(C("kind") == "logo") & _any_contains(name, LOGO_WORDS), (PASS, "logo_valid")),
        (yes(C("kind") == "logo"), (REVIEW, "logo_review")),
        (yes(C("kind") == "icon") & poor, (FAIL, "icon_terse")),
        default=(PASS, "informative_valid"),
    )


def relationships() -> Column:
    """1.3.1."""
    field = yes(C("tag").isin("input", "select", "textarea"))
    grouped = yes(C("section") == "form_region") | filled("described_by") | yes(F.arrays_overlap(F.split(F.coalesce("ancestor_roles", F.lit("")), ","), F.array(F.lit("group"), F.lit("radiogroup"))))
    return _decide((yes("in_data_table"), (PASS, "table_context")), (field & yes(C("type").isin("radio", "checkbox")) & ~grouped, (REVIEW, "orphaned_input")), (field & ~filled("name") & ~filled("visible_label"), (FAIL, "missing_relationship")), (field, (PASS, "valid_relationship")), default=(NA, "not_applicable"))


def text_contrast(level: str = "AA") -> Column:
    """1.4.3, or 1.4.6 with AAA: struct(status, code, ratio)."""
    large = color.large_text(C("font_px"), C("font_weight"))
    ratio = color.contrast(color.parse_rgb(C("fg")), color.parse_rgb(C("bg")))
    need = F.when(large, 3.0 if level == "AA" else 4.5).otherwise(4.5 if level == "AA" else 7.0)
    word = "contrast" if level == "AA" else "contrast_enhanced"

    def decide(r: Column) -> Column:
        s = lambda st, code: F.struct(F.lit(st).alias("status"), F.lit(code).alias("code"), r.alias("ratio"))
        return cases(
            (~filled("name") & ~filled("ocr_text") & ~filled("visible_label"), s(NA, "no_text")),
            (yes(C("kind").isin("logo", "decorative")) | yes("disabled"), s(PASS, "contrast_exempt")),
            (C("bg").contains("rgba") & C("bg").endswith(", 0)"), s(REVIEW, "transparent_bg")),
            (r >= need, s(PASS, f"{word}_sufficient")),
            default=s(FAIL, f"{word}_insufficient"),
        )

    return color.let(ratio, decide)


def images_of_text() -> Column:
    """1.4.5."""
    plain = lambda c: F.regexp_replace(F.lower(C(c)), "[^a-z0-9]", "")
    words = F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) > 3
    return _decide((yes(C("kind").isin("logo", "decorative", "complex", "chart")), (NA, "exemption_applies")), (yes("video_context"), (NA, "video_thumbnail_exempt")), (words & filled("name") & (plain("ocr_text") == plain("name")), (PASS, "text_matches_alt")), (words, (REVIEW, "potential_image_of_text")), default=(PASS, "no_text_detected"))


def component_contrast() -> Column:
    """1.4.11."""
    ui = yes("focusable") | yes(C("tag").isin("input", "button", "select", "textarea"))
    clear = yes(C("bg").endswith(", 0)")) & yes(C("border").endswith(", 0)"))
    return _decide((~ui & ~yes(C("kind") == "icon"), (NA, "not_ui_component")), (yes("disabled"), (PASS, "inactive_exempt")), (clear, (REVIEW, "no_explicit_boundary")), default=(REVIEW, "boundary_contrast_review"))


def focus_visible() -> Column:
    """2.4.7."""
    return _decide((~yes("focusable"), (NA, "not_focusable")), (yes(C("display") == "none"), (NA, "hidden_element")), (yes("focus_ring"), (PASS, "focus_indicator_present")), default=(FAIL, "no_focus_indicator"))


def focus_appearance(thickness: float = 1.0, ratio: float = 3.0) -> Column:
    """2.4.13: a thin ring needs contrast."""
    thin = C("ring_px") < thickness
    return _decide((~yes("focusable"), (NA, "not_focusable")), (~yes("focus_ring"), (FAIL, "no_focus_indicator")), (thin & (C("ring_contrast").isNull() | (C("ring_contrast") < ratio)), (REVIEW, "thin_or_low_contrast_focus")), default=(PASS, "valid_focus_appearance"))


def label_in_name() -> Column:
    """2.5.3: letters, digits, kana and ideographs of the label are contained in those of the name."""
    plain = lambda c: F.regexp_replace(F.lower(C(c)), "[^a-z0-9぀-ゟ゠-ヿ一-鿿]", "")
    return _decide((~filled("visible_label") | ~filled("name"), (NA, "no_visible_label")), (plain("visible_label") == "", (NA, "empty_visible_label")), (F.contains(plain("name"), plain("visible_label")), (PASS, "label_contained")), default=(FAIL, "label_mismatch"))


def target_size() -> Column:
    """2.5.8."""
    inline = yes(C("in_paragraph")) | yes(C("display") == "inline")
    return _decide((~yes("focusable") & ~yes(C("tag").isin("button", "a", "input")), (NA, "not_interactive")), (inline, (PASS, "inline_exception")), ((C("w") >= 24) & (C("h") >= 24), (PASS, "size_meets_minimum")), (C("spacing") >= 24, (PASS, "spacing_exception")), default=(FAIL, "undersized_target"))


def section(tags: Column, roles: Column) -> Column:
    """The nearest ancestor's section, its role before its tag; arrays run from the nearest outwards."""
    known = F.create_map(*[F.lit(x) for kv in LANDMARKS.items() for x in kv])
    found = F.filter(F.transform(F.arrays_zip(tags.alias("t"), roles.alias("r")), lambda x: F.coalesce(F.element_at(known, F.lower(x["r"])), F.element_at(known, F.lower(x["t"])))), lambda s: s.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit("unknown"))


def applicable() -> Column:
    """The criteria that apply to an element, as an array."""
    image = yes(C("tag").isin("img", "svg")) | yes(C("role") == "img")
    active = yes(C("tag").isin("button", "a", "input", "select", "textarea")) | yes(C("role").isin("button", "link", "checkbox", "radio", "menuitem", "tab", "textbox")) | yes("focusable")
    words = filled("name") | filled("ocr_text") | filled("visible_label")
    some = lambda c, *sc: F.when(c, F.array(*[F.lit(s) for s in sc])).otherwise(F.array().cast("array<string>"))
    return F.concat(some(image, "1.1.1", "1.4.5"), some(active, "1.3.1", "1.4.11", "2.4.7", "2.4.13", "2.5.3", "2.5.8"), some(words, "1.4.3", "1.4.6"))
