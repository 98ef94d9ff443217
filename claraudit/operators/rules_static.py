"""Row-level rules on element records: each gives (status, reason code) as one ordered CASE, evaluated inside the scan's
stage. Statuses: PASSED, FAILED, NEEDS_REVIEW, N/A, WARNING, INFO, INCOMPLETE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claraudit.functions import text

C = F.col
MIN_TARGET, MAX_MOTION_S, CONTRAST_UI = 24.0, 5.0, 3.0

# What marks a field as required in its label or placeholder.
REQUIRED_MARKS = r"(?i)\*|\(required\)|\brequired\b|\breq(?:uired)?\s*:|必須|必要|obligatoire|obrigatório|pflichtfeld|erforderlich|obbligatorio|obligatorio"
# Input types and parts of names that ask for personal data.
PERSONAL_TYPES = ("email", "tel", "url", "password", "name")
PERSONAL_NAMES = ("email", "phone", "tel", "password", "username", "first-name", "last-name", "firstname", "lastname", "address", "city", "zip", "postcode", "country")


def cases(*pairs: tuple[Column, str | Column], default: str | Column) -> Column:
    """The value of the first true condition; a null condition is not true."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def verdict(*pairs: tuple[Column, tuple[str, str]], default: tuple[str, str]) -> Column:
    """struct(status, reason) of the first true condition."""
    s = lambda v: F.struct(F.lit(v[0]).alias("status"), F.lit(v[1]).alias("reason"))
    return cases(*[(c, s(v)) for c, v in pairs], default=s(default))


def yes(c: Column | str) -> Column:
    return F.coalesce(C(c) if isinstance(c, str) else c, F.lit(False))


def filled(c: str) -> Column:
    return F.coalesce(C(c), F.lit("")) != ""


def violations(*pairs: tuple[Column, str]) -> Column:
    """The codes of all true conditions, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))


def _required() -> Column:
    return yes("required") | (F.lower(F.trim(F.coalesce("aria_required", F.lit("")))) == "true")


def error_identification() -> Column:
    """3.3.1: a required field names an error element that exists, and that element announces itself."""
    live = yes("error_has_role_alert") | yes(C("error_has_aria_live").isin("assertive", "polite"))
    return violations((_required() & ~filled("aria_describedby"), "no_describedby"), (_required() & filled("aria_describedby") & ~filled("error_element_id"), "dangling_describedby"), (filled("error_element_id") & ~live, "silent_error"))


def labels_or_instructions() -> Column:
    """3.3.2: label, required mark, more than a placeholder, autocomplete for personal data."""
    looks = F.concat_ws(" ", "label_text", "placeholder", "aria_label").rlike(REQUIRED_MARKS)
    name = F.lower(F.coalesce("name", F.lit("")))
    personal = F.lower(F.coalesce("type", F.lit(""))).isin(*PERSONAL_TYPES) | reduce(lambda a, b: a | b, [name.contains(n) for n in PERSONAL_NAMES])
    return violations((~yes("has_any_label"), "no_label"), (~_required() & looks, "required_unmarked"), (~yes("has_any_label") & (F.trim(F.coalesce("placeholder", F.lit(""))) != ""), "placeholder_only"), (personal & ~filled("autocomplete"), "no_autocomplete"))


def status_of_violations(v: Column) -> Column:
    return F.when(F.size(v) > 0, "FAILED").otherwise("PASSED")


def target_size() -> Column:
    """2.5.8: three exceptions, then 24 by 24."""
    return verdict((yes("is_inline_exception"), ("N/A", "inline")), (yes("is_ua_controlled_exception"), ("N/A", "user_agent")), (yes("is_offset_exception"), ("N/A", "offset")), ((C("rendered_width_px") >= MIN_TARGET) & (C("rendered_height_px") >= MIN_TARGET), ("PASSED", "")), default=("FAILED", "small"))


def text_spacing() -> Column:
    """1.4.12, static: fixed heights, with cut-off content or not."""
    fixed = yes("has_fixed_height")
    return verdict((yes(C("text_length") < 20) | yes(C("tag").isin("html", "body", "img", "svg", "canvas")), ("N/A", "not_text")), (fixed & yes("has_overflow_hidden"), ("WARNING", "fixed_and_hidden")), (fixed, ("INFO", "fixed")), default=("PASSED", ""))


def pause_stop_hide() -> Column:
    """2.2.2: what starts by itself and lasts over 5 seconds needs a mechanism. -1 is endless, null unknown."""
    endless = yes(C("duration_seconds") == -1) | yes(C("iteration_count") == "infinite") | yes("loops")
    unknown = ~endless & C("duration_seconds").isNull() & ~yes("duration_known")
    brief = ~endless & yes(C("duration_seconds") <= MAX_MOTION_S)
    return verdict(
        (yes(C("exception") == "loading_indicator"), ("N/A", "loading")),
        (~yes("starts_automatically"), ("PASSED", "not_automatic")),
        (unknown & yes("has_mechanism"), ("PASSED", "mechanism")),
        (unknown, ("NEEDS_REVIEW", "unknown_duration")),
        (brief, ("PASSED", "brief")),
        (yes("has_mechanism"), ("PASSED", "mechanism")),
        default=("FAILED", "no_mechanism"),
    )


def label_in_name() -> Column:
    """2.5.3, static: the visible words stand, whole, in the accessible name. Columns label and name, normalised before by
    normalize_label(); CJK labels are contained anywhere."""
    plain = lambda c: text.collapse(F.regexp_replace(C(c), r"(?U)[^\w\s]", " "))
    label, name = plain("label"), plain("name")
    inside = F.when(C("label").rlike(text.CJK), name.contains(label)).otherwise(text.word_contains(name, label))
    return verdict((~yes(label.rlike(r"(?U)\w")), ("N/A", "no_words")), (text.blank_to_null(C("name")).isNull(), ("FAILED", "no_name")), (yes(inside), ("PASSED", "")), default=("FAILED", "not_in_name"))


def image_name() -> Column:
    """4.1.2, functional images: a name that says something; logos name their brand, social icons more than the brand."""
    alt = text.norm_alt(F.coalesce("alt", F.lit("")))
    generic = alt.isin("image", "icon", "button", "link", "picture", "graphic", "logo", "photo", "img")
    return verdict((~yes("is_functional"), ("N/A", "not_functional")), (alt == "", ("FAILED", "no_name")), (generic, ("FAILED", "generic")), (yes(C("sub_type") == "social") & alt.isin("facebook", "twitter", "instagram", "youtube", "linkedin"), ("FAILED", "brand_only")), default=("PASSED", ""))


def images_of_text() -> Column:
    """1.4.5: text in images that aren't decorative, complex or logos."""
    kind, words = C("classification"), F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) > 0
    return verdict((yes(kind == "decorative"), ("N/A", "decorative")), (yes(kind == "complex"), ("PASSED", "essential")), (yes(kind == "logo"), ("PASSED", "logo")), (yes(kind == "logo_with_text"), ("FAILED", "logo_and_text")), (~words, ("PASSED", "no_text")), default=("FAILED", "text"))


def non_text_contrast() -> Column:
    """1.4.11, images: boundary ratio, undecided edges, then the least ratio of the regions."""
    return verdict((~yes("is_ui_component"), ("N/A", "not_ui")), (yes(C("boundary_ratio") < CONTRAST_UI), ("FAILED", "boundary")), (yes("edge_undecided"), ("INCOMPLETE", "edge")), (yes(C("min_region_ratio") < CONTRAST_UI), ("FAILED", "region")), default=("PASSED", ""))


def alt_text() -> Column:
    """1.1.1 by class of image: decorative ones are silent, others have an alternative that fits."""
    alt = text.norm_alt(F.coalesce("alt", F.lit("")))
    kind = C("classification")
    shared = F.arrays_overlap(F.filter(F.split(alt, " "), lambda w: F.length(w) >= 3), F.filter(F.split(text.norm_alt(F.coalesce("ocr_text", F.lit(""))), " "), lambda w: F.length(w) >= 3))
    return verdict(
        (yes(kind == "decorative") & (alt == ""), ("PASSED", "decorative")),
        (yes(kind == "decorative"), ("FAILED", "decorative_named")),
        (C("alt").isNull(), ("FAILED", "missing")),
        (alt == "", ("FAILED", "empty")),
        (alt.isin("image", "picture", "photo", "icon", "graphic", "spacer"), ("FAILED", "generic")),
        (yes(kind == "informative") & (F.trim(F.coalesce("ocr_text", F.lit(""))) != "") & ~yes(shared), ("FAILED", "text_not_in_alt")),
        (yes(kind == "icon") & (F.length(alt) < 3), ("FAILED", "terse")),
        default=("PASSED", ""),
    )


def image_overall() -> Column:
    """All of an image's rules together; an unknown part doesn't fail it, an unknown main one does."""
    known = lambda c: F.coalesce(C(c), F.lit(True))
    return F.when(yes("ok_1_1_1") & known("ok_4_1_2") & known("ok_1_4_5") & known("ok_1_4_11"), "PASSED").otherwise("FAILED")


def image_metadata() -> Column:
    """What an image's metadata alone gives away, over four criteria."""
    name = F.coalesce(text.blank_to_null(C("alt")), text.blank_to_null(C("aria_label")), text.blank_to_null(C("title")))
    return violations((C("alt").isNull() & name.isNull() & ~yes("is_decorative"), "1.1.1:no_alternative"), (yes("is_decorative") & name.isNotNull(), "1.1.1:decorative_named"), (yes("has_click") & ~yes("is_focusable"), "2.1.1:mouse_only"), (yes("in_link") & name.isNull(), "2.4.4:empty_link"), (yes("has_click") & name.isNull(), "4.1.2:no_name"))


def audio_video() -> Column:
    """1.2.1 by gates: live, kind, labelled alternative, decorative, transcript. gate: where the decision fell."""
    s = lambda gate, status: F.struct(F.lit(gate).alias("gate"), F.lit(status).alias("status"))
    live = yes(C("src").rlike(r"(?i)\.(m3u8|mpd)(\?|$)|\blive\b"))
    silent = yes("muted") & yes("loop") & yes("autoplay")
    both = yes(C("kind") == "video") & ~silent
    transcript = yes("has_track") | yes(F.lower(C("link_text")).rlike("transcript|text version")) | yes(F.length("described_by") > 50)
    return cases((live, s(1, "N/A")), (both, s(2, "N/A")), (yes("is_labelled_alternative"), s(3, "PASSED")), (yes("is_decorative"), s(4, "PASSED")), (~transcript, s(5, "FAILED")), default=s(6, "NEEDS_REVIEW"))


def quality_overall(statuses: Column) -> Column:
    """Any failure fails; all passed passes; else review."""
    return F.when(F.exists(statuses, lambda s: s == "FAILED"), "FAILED").when(F.forall(statuses, lambda s: s == "PASSED"), "PASSED").otherwise("NEEDS_REVIEW")
