"""Checks of forms, handlers and focus on element records, and what becomes of scanner results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import color, text
from claraudit.operators.rules_static import cases, filled, violations, yes

C = F.col
# Words of risky forms, safeguards, and terse or helpful error messages.
FINANCIAL = r"(?i)\b(pay|payment|purchase|buy|checkout|transfer|card)\b"
LEGAL = r"(?i)\b(contract|agreement|terms|legal|consent)\b"
DESTRUCTIVE = r"(?i)\b(delete|remove|cancel|erase|terminate)\b"
REVIEW = r"(?i)\b(review|confirm|verify|check your)\b"
TERSE = r"(?i)^(invalid|error|required|failed|incorrect|wrong)( (input|value|field|entry))?\.?$"
SUGGESTS = r"(?i)\b(please|must|should|enter|use|try|example|e\.g\.|such as|at least|at most|format)\b"
INFORMATIVE = r"(?i)\d|[@A-Za-z][-–—][A-Za-z0-9]|\b(only|format|characters?|digits?|letters?|symbols?|uppercase|lowercase|special)\b"
# Process types and the words that tell them.
PROCESSES = {
    "subscribe": r"(?i)\b(newsletter|subscribe)\b|ニュースレター|購読",
    "contact": r"(?i)\b(contact|enquiry|inquiry|quote|support|feedback)\b|問い合わせ|見積|サポート|フィードバック",
    "checkout": r"(?i)\b(checkout|payment|billing|shipping|delivery|order|purchase)\b|購入|注文|配送|請求|支払い",
    "account": r"(?i)\b(register|registration|signup|sign[\s-]?up|account|profile)\b|登録|アカウント|プロフィール",
    "application": r"(?i)\b(application|apply|careers?|job)\b|応募",
    "booking": r"(?i)\b(booking|reservation)\b|予約",
}
DOWN, ACTION = r"(?i)on(mouse|pointer|touch)(down|start)", r"(?i)submit|navigate|location|open|delete|click\("


def error_suggestion(message: Column) -> Column:
    """3.3.3: terse, or short with neither a suggestion nor any information."""
    poor = message.rlike(TERSE) | (~message.rlike(SUGGESTS) & (F.length(message) < 25) & ~message.rlike(INFORMATIVE))
    return cases((message.isNull() | (message == ""), "incomplete"), (poor, "fail"), default="pass")


def error_prevention(words: Column, safeguard: Column) -> Column:
    """3.3.4: class of a risky form, destructive before financial before legal, and whether a safeguard is there."""
    kind = cases((words.rlike(DESTRUCTIVE), "destructive"), (words.rlike(FINANCIAL), "financial"), (words.rlike(LEGAL), "legal"), default=F.lit(None).cast("string"))
    return F.struct(kind.alias("kind"), cases((kind.isNull(), "pass"), (yes(safeguard) | words.rlike(REVIEW), "pass"), default="fail").alias("status"))


# Whose data two fields of one key may ask for without asking twice.
DISTINCT_ROLES = (("billing", "shipping"), ("primary", "secondary"), ("emergency", "primary"), ("emergency", "applicant"), ("guardian", "applicant"), ("reference", "applicant"))


def process_types(words: Column) -> Column:
    return F.array_compact(F.array(*[F.when(words.rlike(p), F.lit(k)) for k, p in PROCESSES.items()]))


def process_type(form_words: Column, field_words: Column) -> Column:
    """A form's single type, else its field's, else the first of both together."""
    a, b = process_types(form_words), process_types(field_words)
    both = process_types(F.concat_ws(" ", form_words, field_words))
    return cases((F.size(a) == 1, F.get(a, 0)), (F.size(b) == 1, F.get(b, 0)), default=F.coalesce(F.get(both, 0), F.lit("unknown")))


def redundant_entry(fields: DataFrame) -> DataFrame:
    """3.3.7 over fields (page, id, key, form, process, required, words, prefilled): pairs of one key in different forms
    of one page. A pair is the same purpose for equal words, for one process and similarity of .45, or .6; distinct for
    different processes below .25. A key with two required fields and a same pair fails, with other pairs it is to be
    reviewed, unless a field is prefilled. Where fields have a role, a key asked of two roles that are different people or
    purposes by nature is left alone. Pages hold few fields of a key, so pairs stay within that."""
    f = fields.withColumn("_t", text.tokens(C("words")))
    j = f.alias("a").join(f.alias("b"), (C("a.page") == C("b.page")) & (C("a.key") == C("b.key")) & (C("a.id") < C("b.id")) & (C("a.form") != C("b.form")))
    sim = text.jaccard(C("a._t"), C("b._t"))
    one = C("a.process") == C("b.process")
    same = (C("a.words") == C("b.words")) | (one & (sim >= 0.45)) | (sim >= 0.6)
    kind = cases((yes(same), "same"), (~yes(one) & (sim < 0.25), "distinct"), default="unclear")
    pairs = j.groupBy(C("a.page").alias("page"), C("a.key").alias("key")).agg(F.count_if(kind == "same").alias("same"), F.count_if(kind == "unclear").alias("unclear"), F.round(F.max(sim), 4).alias("best"))
    group = fields.groupBy("page", "key").agg(F.count_if("required").alias("required"), F.coalesce(F.bool_or("prefilled"), F.lit(False)).alias("eased"))
    if "role" in fields.columns:
        roles = fields.groupBy("page", "key").agg(F.collect_set("role").alias("_roles"))
        apart = [F.array_contains("_roles", a) & F.array_contains("_roles", b) for a, b in DISTINCT_ROLES]
        group = group.join(roles, ["page", "key"]).filter(~reduce(lambda x, y: x | y, apart)).drop("_roles")
    g = pairs.join(group, ["page", "key"]).filter("required >= 2")
    return g.select("page", "key", "best", cases((C("eased"), "pass"), ((C("same") > 0) | (C("best") >= 0.5), "fail"), (C("unclear") > 0, "incomplete"), default="pass").alias("status"))


def images_of_text(min_words: int = 5) -> Column:
    """1.4.5 score of an image: source 2, class 1, long alternative 1, sentence 1; 3 fails, 2 is to be reviewed."""
    alt = F.trim(F.coalesce("alt", F.lit("")))
    words = F.size(F.filter(F.split(alt, r"\s+"), lambda w: w != ""))
    cjk = alt.rlike("[぀-ヿ㐀-鿿]")
    signs = [(C("src").rlike(r"(?i)text|banner|heading|title"), 2), (C("class").rlike(r"(?i)text|banner|heading"), 1), (F.when(cjk, F.length(alt) >= 8).otherwise(words >= min_words), 1), (alt.rlike(r"[.!?。！？]$") | (alt.rlike("^[A-Z]") & (words >= 4)) | (cjk & (F.length(alt) >= 12)), 1)]
    score = sum((F.when(yes(c), n).otherwise(0) for c, n in signs), F.lit(0))
    skip = (alt == "") | yes(C("role").isin("presentation", "none")) | F.concat_ws(" ", "alt", "src", "class").rlike("(?i)logo")
    return cases((skip, "skipped"), (score >= 3, "fail"), (score == 2, "incomplete"), default="pass")


def use_of_color(most: int = 15) -> Column:
    """1.4.1: a link that differs from its text by colour alone."""
    a, b = color.parse_rgb(C("link_color")), color.parse_rgb(C("text_color"))
    differs = F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > most)
    cue = yes("underlined") | yes("bold") | yes("bordered")
    return cases((cue, "pass"), (differs, "fail"), default="pass")


def status_messages() -> Column:
    """4.1.3: a changing part without a live region fails; with one it is to be reviewed."""
    return cases((yes("dynamic") & ~yes("live_region"), "fail"), (yes("dynamic"), "incomplete"), (yes("live_region"), "pass"), default="incomplete")


def accessible_auth() -> Column:
    """3.3.8: an authentication form with a puzzle, blocked pasting or a cognitive test; a passkey exempts."""
    return F.when(~yes("is_auth") | yes("passkey"), F.array().cast("array<string>")).otherwise(violations((yes("captcha") & ~yes("captcha_alternative"), "captcha"), (yes("paste_blocked"), "paste"), (yes("cognitive_test"), "cognitive")))


def char_keys() -> Column:
    """2.1.4: a printable access key, or a key handler that reads keys and asks for no modifier within 120 characters."""
    at = F.locate("event.key", C("handler"))
    near = F.substring(C("handler"), at, 120)
    bare = (at > 0) & ~near.rlike("ctrlKey|altKey|metaKey")
    return cases((yes(F.length(C("accesskey")) == 1), "incomplete"), (yes(bare), "incomplete"), default="pass")


def pointer_cancel() -> Column:
    """2.5.2: an action on the down event without an up handler."""
    return cases((yes(C("attrs").rlike(DOWN)) & yes(C("attrs").rlike(ACTION)) & ~yes(C("attrs").rlike(r"(?i)on(mouse|pointer|touch)(up|end)")), "incomplete"), default="pass")


def dragging() -> Column:
    """2.5.7: something that can be dragged and has no other control."""
    drag = yes(C("attrs").rlike(r'(?i)draggable="true"|ondrag|data-sortable|ui-draggable'))
    return cases((drag & ~yes("alternative"), "incomplete"), default="pass")


def focus_change() -> Column:
    """2.4.7 by two style snapshots: a visible outline, or a change of shadow, border, background or colour."""
    outline = (C("f_outline") != "none") & (C("f_outline_px") > 0)
    moved = [yes(C(f"f_{p}") != C(f"u_{p}")) for p in ("shadow", "border", "background")]
    return cases((yes(outline) | moved[0] | moved[1] | moved[2], "pass"), default="fail")


def focus_indicator() -> Column:
    """2.4.13: an indicator, 2 px wide, of contrast 3."""
    outline = (C("f_outline") != "none") & (C("f_outline_px") > 0)
    some = yes(outline) | yes(C("f_shadow") != C("u_shadow"))
    return violations((~some, "no_indicator"), (some & yes(outline) & yes(C("f_outline_px") < 2), "thin"), (some & yes(C("ratio") < 3), "low_contrast"))


def moved_away(before: Column, after: Column) -> Column:
    """3.2.1, 3.2.2: whether path or query changed."""
    from claraudit.functions.urls import path_query

    return F.coalesce(path_query(before) != path_query(after), F.lit(False))


def first_move(steps: DataFrame) -> DataFrame:
    """page, step of each page's first change."""
    return steps.filter("moved").groupBy("page").agg(F.min_by("step", "step").alias("step"))


def meaningful_sequence(order: Column) -> Column:
    """1.3.2: positions in the markup don't follow the visual order."""
    return cases((order != F.array_sort(order), "incomplete"), default="pass")


def audio_transcript() -> Column:
    """1.2.1, page side: track, transcript link, caption, details or a long description."""
    some = yes("track") | yes(F.lower(C("links")).contains("transcript")) | filled("figcaption") | yes("details") | yes(F.length("described") > 50)
    return cases((some, "pass"), default="incomplete")


def criterion_of(tags: Column, rule: Column, fallback: dict[str, str]) -> Column:
    """The criterion of a scanner rule: its first wcag tag with three or four digits, else a fallback by rule, else
    best-practice, else null."""
    tag = F.get(F.filter(tags, lambda t: t.rlike(r"^wcag\d{3,}$")), 0)
    dotted = F.when(F.length(tag).isin(7, 8), F.regexp_replace(tag, r"^wcag(\d)(\d)(\d{1,2})$", "$1.$2.$3"))
    known = cases(*[(rule == k, v) for k, v in fallback.items()], default=F.lit(None).cast("string"))
    return F.coalesce(dotted, known, F.when(F.array_contains(tags, "best-practice"), F.lit("best-practice")))


def elements_of(reason: Column, most: int = 3) -> Column:
    """Up to three distinct elements that a reason quotes."""
    found = F.regexp_extract_all(F.coalesce(reason, F.lit("")), F.lit(r"<[a-zA-Z][\w:-]*[^>]*>"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.substring(x, 1, 600))), 1, most)


def flat_custom(rules: DataFrame) -> DataFrame:
    """A row for each element of a custom rule: explicit ones, its own, those its reason quotes, else the page."""
    none = F.array().cast("array<string>")
    pick = lambda *xs: cases(*[(F.size(x) > 0, x) for x in xs], default=F.array(F.lit("<html>")))
    explicit = F.coalesce(C("elements"), none)
    own = F.when(filled("element"), F.array(C("element"))).otherwise(none)
    return rules.withColumn("html", F.explode(pick(explicit, own, elements_of(C("reason")))))


def scanner_groups(results: DataFrame) -> DataFrame:
    """A status for each rule of a scanner: fail before pass before incomplete."""
    rank = cases((C("status") == "fail", "0fail"), (C("status") == "pass", "1pass"), default="2incomplete")
    return results.groupBy("rule").agg(F.substring(F.min(rank), 2, 20).alias("status"))


def ocr_budget(images: DataFrame, most: int = 60) -> DataFrame:
    """Which images get text recognition: repeated decorative ones and logos once by source, then the first `most` by
    priority and place, for each page."""
    low = yes("is_decorative") | yes("is_logo")
    asset = F.when(low & filled("src"), F.concat_ws(":", "classification", "src")).otherwise(F.concat(F.lit("#"), C("id").cast("string")))
    once = images.withColumn("_r", F.row_number().over(Window.partitionBy("page", asset).orderBy("id"))).filter("_r = 1").drop("_r")
    priority = cases((yes("is_button"), F.lit(0)), (yes("is_text"), F.lit(1)), (yes(C("classification") == "functional"), F.lit(2)), (yes(C("classification") == "informative"), F.lit(3)), (yes("is_logo"), F.lit(5)), (yes("is_decorative"), F.lit(7)), default=F.lit(6))
    place = F.row_number().over(Window.partitionBy("page").orderBy("_p", "id"))
    return once.withColumn("_p", priority).withColumn("selected", place <= most).select("page", "id", "selected")
