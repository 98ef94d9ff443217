"""Checks of styled elements (sources.css.styled): reading order, orientation, animations. Containers and their children meet
by a window or a join on (page, parent); nothing is gathered but a container's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import urls
from claraudit.operators import structure
from claraudit.sources.css import value
from claraudit.sources.html import ROLES, attr

# Languages written from right to left, elements that make up a page's layout, what locks an orientation.
RTL = r"(?i)^(ar|he|fa|ur|yi|arc|ckb)\b"
LAYOUT_TAGS = ("body", "main", "header", "footer", "section", "article", "aside", "nav")
LAYOUT_ROLES = ("main", "banner", "contentinfo", "navigation", "region", "complementary")
LAYOUT_NAME = r"(?i)^(app|root|wrapper|container|layout|page|content|main|body|screen)(-.*)?$"
LOCK = r"screen\s*\.\s*(?:orientation\s*\.\s*lock|lockOrientation|mozLockOrientation|msLockOrientation|webkitLockOrientation)\s*\("
QUARTER = r"(-?(?:90|270)(?:\.\d+)?deg|-?(?:0\.5|1\.5)turn|-?(?:1\.5707|4\.7123)\s*rad)"
HIDES = r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden|height\s*:\s*[01]px|pointer-events\s*:\s*none)"
RESHAPES = r"(?i)(?:position\s*:\s*(?:fixed|absolute)|width\s*:\s*(?:0px|[0-9]+vh)|height\s*:\s*(?:0px|[0-9]+vw)|overflow\s*:\s*hidden|clip\s*:\s*rect)"
ORIENTATION = r"(?i)orientation\s*:\s*(portrait|landscape)"
LOCKED = ("portrait", "landscape", "portrait-primary", "portrait-secondary", "landscape-primary", "landscape-secondary")
DEFINITE = ("script-lock", "meta-viewport-orientation", "manifest-orientation", "writing-mode")
STATUS_WORDS = r"(?i)(^|[\s:_-])(spinner|loading|loader|progress|busy|skeleton|shimmer|throbber|preload|placeholder|buffer)([\s:_-]|$)"
STATUS_TEXT = r"(?i)loading|please wait|working|processing|buffering|syncing|saving|uploading|読み込み|ロード中|処理中|進行中"
PAUSE = "pause|stop|一時停止|停止|止める|再生停止"
# Inputs that are targets, those that browsers draw, elements that flow in a line, the least size in pixels.
TARGET_INPUTS = ("submit", "button", "reset", "image", "checkbox", "radio")
DRAWN_INPUTS = ("checkbox", "radio")
INLINE_TAGS = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u")
LEAST_TARGET = 24.0


def _whole(c: Column) -> Column:
    """The whole number that a text begins with, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d{1,9})", 1), F.lit("")).cast("int"), F.lit(0))


def reordered(styled: DataFrame, most: int | None = None) -> DataFrame:
    """1.3.2: page_id, pos, tag, code of flex and grid containers whose children are shown in another order than they are
    written. most: only so many containers of a page, its first ones; without it all."""
    from claraudit.operators.structure import inside

    page = F.first(F.when(F.col("tag") == "html", F.struct(F.lower(attr("dir")).alias("dir"), attr("lang").alias("lang"))), ignorenulls=True).over(Window.partitionBy("page_id"))
    right = F.coalesce(attr("dir") == "rtl", F.lit(False))
    rows = styled.withColumn("_page", page).withColumn("_rtl", inside(right, "page_id") | right)
    rtl = F.col("_rtl") | F.coalesce(F.col("_page.dir") == "rtl", F.lit(False)) | F.coalesce(F.col("_page.lang").rlike(RTL), F.lit(False))
    display = value("display", "")
    boxes = rows.filter(display.isin("flex", "inline-flex", "grid", "inline-grid")).select("page_id", "pos", "tag", display.rlike("grid").alias("grid"), value("flex-direction", "").alias("flow"), rtl.alias("rtl"))
    if most is not None:
        boxes = boxes.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")
    shown = (value("display", "") != "none") & ~value("visibility", "").isin("hidden", "collapse") & (value("opacity", "1").try_cast("double").isNull() | (value("opacity", "1").try_cast("double") != 0))
    child = rows.filter(shown & F.col("parent").isNotNull()).select("page_id", "pos", F.col("parent"), F.col("tag").isin("button", "a", "input", "select").alias("control"), attr("role").isNotNull().alias("role"), _whole(value("order", "0")).alias("order"), ((value("grid-column-start", "auto") != "auto") | (value("grid-row-start", "auto") != "auto")).alias("placed"), value("float", "none").alias("float"))
    child = child.withColumn("_down", F.lag("order").over(Window.partitionBy("page_id", "parent").orderBy("pos")) > F.col("order"))
    per = child.groupBy("page_id", "parent").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("control") | F.col("role")).alias("controls"), F.bool_or("_down").alias("down"), F.bool_or("placed").alias("placed"), F.bool_or(F.col("float").isin("left", "right")).alias("floated"), F.bool_or(F.col("float") == "none").alias("still"))
    met = boxes.join(per.withColumnRenamed("parent", "pos"), ["page_id", "pos"]).filter("n >= 2")
    reverse = F.col("flow").isin("row-reverse", "column-reverse")
    met = met.filter(~((F.col("flow") == "row-reverse") & F.col("rtl")) & ~(reverse & F.col("controls")))
    code = F.when(F.col("grid") & F.col("placed"), "grid-explicit-placement").when(F.col("floated") & F.col("still"), "mixed-floats").when(reverse, "flex-direction-reverse").when(F.coalesce("down", F.lit(False)), "css-order-reorders")
    return met.withColumn("code", code).filter("code is not null").select("page_id", "pos", "tag", "code")


def meaningful_sequence(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, n, codes, status of each page from reordered()."""
    per = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return pages.select("page_id").join(per, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("codes", F.lit("")).alias("codes"), F.when(F.col("n").isNull(), "pass").otherwise("incomplete").alias("status"))


def _name_of() -> Column:
    """An element as a selector: tag, id and classes."""
    classes = F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), c)), "")
    return F.concat("tag", F.coalesce(F.concat(F.lit("#"), F.nullif("id", F.lit(""))), F.lit("")), classes)


def _angle(c: Column) -> Column:
    """Degrees by which a transform turns, rounded, from -180 to 180; null if it doesn't say."""
    number = F.regexp_extract(c, r"rotatez?\(\s*(-?[\d.]+)\s*(deg|turn|g?rad)\s*\)", 1).try_cast("double")
    unit = F.regexp_extract(c, r"rotatez?\(\s*(-?[\d.]+)\s*(deg|turn|g?rad)\s*\)", 2)
    turned = F.when(unit == "deg", number).when(unit == "turn", number * 360).when(unit == "grad", number * 0.9).when(unit == "rad", F.degrees(number))
    parts = [F.regexp_extract(c, r"matrix(?:3d)?\(\s*([-\d.e]+)\s*,\s*([-\d.e]+)", i).try_cast("double") for i in (1, 2)]
    angle = F.coalesce(turned, F.degrees(F.atan2(parts[1], parts[0])))
    return F.round(angle - 360 * F.round(angle / 360))


def orientation(styled: DataFrame, sheet: DataFrame, pages: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """1.3.4: page_id, kind, target, detail, status of what ties a page to one orientation. pages: page_id, url; manifests:
    page_id, body (a web app manifest's JSON)."""
    row = lambda kind, target, detail: ["page_id", F.lit(kind).alias("kind"), target.alias("target"), detail.alias("detail")]
    scripts = styled.filter("tag = 'script' and content is not null").filter(attr("src").isNull())
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    calls = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(LOCK), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", "")))
    locks = scripts.withColumn("_n", number).withColumn("_calls", calls).filter(F.size("_calls") > 0).select(*row("script-lock", F.concat(F.lit("inline <script> #"), F.col("_n")), F.array_join("_calls", ", ")))

    layout = F.col("tag").isin(*LAYOUT_TAGS) | F.coalesce(attr("role").isin(*LAYOUT_ROLES), F.lit(False)) | F.coalesce(F.col("id").rlike(LAYOUT_NAME), F.lit(False)) | F.exists("classes", lambda c: c.rlike(LAYOUT_NAME))
    inline = F.regexp_extract(F.lower(F.coalesce(attr("style"), F.lit(""))), r"(?:^|;)\s*transform\s*:\s*([^;]*)", 1)
    angle, turn = _angle(value("transform", "")), value("rotate", "")
    ways = F.array_compact(F.array(F.when(F.abs(angle) == 90, F.concat(F.lit("transform "), angle.cast("int").cast("string"))), F.when(inline.rlike(rf"rotate\(\s*{QUARTER}\s*\)"), "inline transform"), F.when(turn.rlike(f"^{QUARTER}$"), F.concat(F.lit("rotate "), turn))))
    rotated = styled.filter(layout).withColumn("_ways", ways).filter(F.size("_ways") > 0).select(*row("css-rotate", _name_of(), F.array_join("_ways", ", ")))

    media = lambda c: F.startswith(F.lower(c), F.lit("@media"))
    oriented = F.filter("media", lambda c: media(c) & c.rlike(ORIENTATION))
    inner = F.try_element_at("media", F.lit(-1))
    # the rule stands directly in the one block that asks for an orientation
    within = sheet.filter((F.size("media") > 0) & F.col("selector").isNotNull()).filter((F.size(oriented) == 1) & media(inner) & inner.rlike(ORIENTATION))
    # a list of selectors is one rule
    within = within.groupBy("page_id", "pos", "rule").agg(F.array_join(F.array_sort(F.collect_set("selector")), ", ").alias("selector"), F.first("css").alias("css"), F.first(F.substring(inner, 8, 1000)).alias("query"))
    hidden, shaped = (within.filter(F.regexp_replace("css", r"^[^{]*\{", "").rlike(p)).select(*row(kind, F.col("selector"), F.col("query"))) for kind, p in (("css-media-hide", HIDES), ("css-media-structural", RESHAPES)))

    sheets = styled.filter((F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+"), "stylesheet") & attr("href").isNotNull())
    sheets = sheets.select("page_id", attr("href").alias("href")).join(pages.select("page_id", "url"), "page_id").withColumn("_to", urls.absolute(F.col("url"), F.col("href")))
    foreign = sheets.filter(~urls.same_origin(F.col("_to"), F.col("url"))).select(*row("cross-origin-sheet", F.col("_to"), F.lit("")))

    meta = styled.filter((F.col("tag") == "meta") & (F.lower(attr("name")) == "viewport")).groupBy("page_id").agg(F.min_by(F.coalesce(attr("content"), F.lit("")), "pos").alias("content"))
    viewport = meta.filter(F.contains(F.lower("content"), F.lit("orientation="))).select(*row("meta-viewport-orientation", F.lit("meta[name=viewport]"), F.col("content")))
    scale = meta.filter(F.col("content").rlike(r"maximum-scale\s*=\s*1(?:\.0+)?\b")).select(*row("viewport-scale", F.lit("meta[name=viewport]"), F.col("content")))
    # the body's own, else what it takes over from the root
    mode = styled.filter(F.col("tag").isin("html", "body")).groupBy("page_id").agg(F.max_by(value("writing-mode"), F.when(value("writing-mode").isNotNull(), (F.col("tag") == "body").cast("int"))).alias("mode"))
    written = mode.filter(F.col("mode").isin("vertical-rl", "vertical-lr")).select(*row("writing-mode", F.lit("body"), F.col("mode")))
    out = locks
    for part in (rotated, hidden, shaped, foreign, viewport, scale, written):
        out = out.unionByName(part)
    if manifests is not None:
        set_to = F.get_json_object("body", "$.orientation")
        out = out.unionByName(manifests.filter(F.lower(set_to).isin(*LOCKED)).select(*row("manifest-orientation", F.lit("manifest.json"), set_to)))
    return out.withColumn("status", F.when(F.col("kind").isin(*DEFINITE), "fail").otherwise("incomplete"))


def _listed(name: str, default: str) -> Column:
    return F.transform(F.split(value(name, default), ","), lambda x: F.trim(x))


def _of_list(values: Column, i: Column) -> Column:
    """The i-th, the first where there are fewer."""
    return F.coalesce(F.nullif(F.get(values, i), F.lit("")), F.get(values, F.lit(0)))


def has_status_signal(text: bool = True) -> Column:
    """An element shows that something is under way: by tag, role, state, names or words."""
    parts = F.concat_ws(" ", attr("id"), attr("class"), attr("aria-label"), attr("title"), attr("data-testid"), attr("data-state"), attr("name"), *([F.col("text")] if text else []))
    words = F.substring(F.trim(F.regexp_replace(parts, r"\s+", " ")), 1, 240)
    known = F.col("tag").isin("progress", "sl-spinner", "sl-progress-ring", "sl-progress-bar") | F.lower(attr("role")).isin("progressbar", "status") | (F.lower(attr("aria-busy")) == "true")
    return F.coalesce(known, F.lit(False)) | words.rlike(STATUS_WORDS) | words.rlike(STATUS_TEXT)


def animations(styled: DataFrame, longer_than: float = 5.0) -> DataFrame:
    """page_id, pos, tag, animation_name, seconds, iterations, loops, duration_seconds (-1: for ever), has_pause_button,
    has_mechanism, exception of visible elements that style sheets animate for longer than 5 seconds. A pause button counts
    within the parent and its parent; a sign of loading counts on the element and 7 ancestors."""
    names, times, counts = _listed("animation-name", "none"), _listed("animation-duration", "0s"), _listed("animation-iteration-count", "1")
    rows = styled.filter(~F.col("hidden") & (value("animation-name", "none") != "none")).select("*", names.alias("_names"), times.alias("_times"), counts.alias("_counts"))
    rows = rows.select("page_id", "pos", "tag", "ancestors", "css", "_times", "_counts", has_status_signal().alias("_busy"), F.posexplode(F.split(F.element_at("css", "animation-name"), ",")).alias("_i", "animation_name"))
    time, iterations = _of_list(F.col("_times"), F.col("_i")), _of_list(F.col("_counts"), F.col("_i"))
    each = F.regexp_extract(time, r"^([\d.]+)", 1).try_cast("double") * F.when(F.endswith(time, F.lit("ms")), 0.001).otherwise(1.0)
    loops = iterations == "infinite"
    rows = rows.withColumns({"animation_name": F.trim("animation_name"), "seconds": each, "iterations": iterations, "loops": loops})
    total = F.when(F.col("loops"), F.lit(-1.0)).otherwise(F.col("seconds") * F.coalesce(F.nullif(F.col("iterations").try_cast("double"), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("duration_seconds", total).filter(F.col("animation_name").isNotNull() & ~F.lower("animation_name").isin("none", "") & (F.col("seconds") > 0) & (F.col("loops") | (F.col("duration_seconds") > longer_than)))
    # pause buttons have their own parents within two steps: both meet in a common one
    button = F.col("tag").isin("button", "a") | (attr("role") == "button")
    said = F.lower(F.coalesce(F.nullif("text", F.lit("")), F.nullif(attr("aria-label"), F.lit("")), attr("title"), F.lit("")))
    pauses = styled.filter(button & said.rlike(PAUSE)).select("page_id", F.col("pos").alias("_at"))
    around = styled.select("page_id", F.col("pos").alias("_box"), F.col("last").alias("_end"))
    near = rows.select("page_id", "pos", F.explode(F.slice("ancestors", 1, 2)).alias("_box")).distinct().join(around, ["page_id", "_box"]).join(pauses, "page_id").filter("_box < _at and _at <= _end").select("page_id", "pos", F.lit(True).alias("_pause")).distinct()
    busy = styled.filter(has_status_signal(False)).select("page_id", F.col("pos").alias("_box"))
    loading = rows.select("page_id", "pos", F.explode(F.slice("ancestors", 1, 7)).alias("_box")).join(busy, ["page_id", "_box"], "left_semi").select("page_id", "pos", F.lit(True).alias("_loading")).distinct()
    rows = rows.join(near, ["page_id", "pos"], "left").join(loading, ["page_id", "pos"], "left")
    pause = F.coalesce("_pause", F.lit(False))
    exception = F.when(F.col("_busy") | F.col("_loading"), "loading_indicator")
    return rows.select("page_id", "pos", "tag", "animation_name", "seconds", "iterations", "loops", "duration_seconds", pause.alias("has_pause_button"), (pause | value("animation-play-state", "").contains("paused")).alias("has_mechanism"), exception.alias("exception"))


def _px(name: str) -> Column:
    """A declared length in pixels, by numbers, px and rem; null for any other."""
    v = value(name)
    number = F.regexp_extract(v, r"^([\d.]+)(?:px|rem)$", 1).try_cast("double")
    return F.when(v.rlike(r"^0(\.0*)?$"), 0.0).otherwise(number * F.when(F.endswith(v, F.lit("rem")), 16.0).otherwise(1.0))


def targets(styled: DataFrame, least: float = LEAST_TARGET) -> DataFrame:
    """Visible targets of raw pages with the size that styles declare (2.5.8): page_id, pos, tag, role, input_type,
    rendered_width_px and rendered_height_px (null where nothing declares them), least_width_px and least_height_px (what
    least sizes and padding leave no doubt of), the inline and user-agent exceptions, status and reason. What else a browser
    computes isn't known here: a target that is too small may still have room around it, so it is to be reviewed, and one of
    unknown size has no status. Elements in one that isn't displayed are left out, however deep."""
    display = value("display", "")
    rows = styled.withColumn("_gone", structure.inside(display == "none", "page_id") | (display == "none") | value("visibility", "").isin("hidden", "collapse"))
    role, kind = F.lower(attr("role")), F.when(F.col("tag") == "input", F.lower(F.coalesce(attr("type"), F.lit("text"))))
    native = (F.col("tag") == "button") | ((F.col("tag") == "a") & attr("href").isNotNull()) | F.coalesce(kind.isin(*TARGET_INPUTS), F.lit(False))
    by_role = F.coalesce(role.isin(*ROLES), F.lit(False)) & ~F.col("tag").isin("button", "a", "input", "select", "textarea")
    rows = rows.filter(~F.col("hidden") & ~F.col("_gone") & (native | by_role)).withColumns({"role": attr("role"), "input_type": kind})
    flows = F.when(display != "", display == "inline").otherwise(F.col("tag").isin(*INLINE_TAGS))
    flows = flows & ~value("float", "none").isin("left", "right") & ~value("position", "static").isin("absolute", "fixed")
    # buttons and fields are sized with their padding, other elements if they say so
    whole = F.when(value("box-sizing").isNotNull(), value("box-sizing") == "border-box").otherwise(F.col("tag").isin("button", "input"))
    border = F.coalesce(_px("border-width"), F.regexp_extract(value("border", ""), r"(?:^|\s)([\d.]+)px", 1).try_cast("double"), F.lit(0.0)) * 2
    sizes = {}
    for name, sides in (("width", ("left", "right")), ("height", ("top", "bottom"))):
        around = F.coalesce(_px(f"padding-{sides[0]}"), F.lit(0.0)) + F.coalesce(_px(f"padding-{sides[1]}"), F.lit(0.0)) + border
        stated = F.coalesce(_px(name), F.when(kind == "image", F.regexp_extract(attr(name), r"^(\d+)$", 1).try_cast("double")))
        low, high = F.coalesce(_px(f"min-{name}"), F.lit(0.0)), F.coalesce(_px(f"max-{name}"), F.lit(float("inf")))
        box = lambda c, around=around: F.when(whole, F.greatest(c, around)).otherwise(c + around)
        sizes[f"rendered_{name}_px"] = F.when(~flows & stated.isNotNull(), box(F.greatest(low, F.least(stated, high))))
        sizes[f"least_{name}_px"] = F.when(flows, around).otherwise(F.coalesce(F.col(f"rendered_{name}_px"), box(low)))
    rows = rows.withColumns({k: v for k, v in sizes.items() if k.startswith("rendered")}).withColumns({k: v for k, v in sizes.items() if k.startswith("least")})
    rows = structure.with_of(rows, "parent", styled, F.length("text").alias("_around"))
    # the parent has words besides the link's
    inline = (F.col("tag") == "a") & flows & F.coalesce(F.col("_around") > F.length("text"), F.lit(False))
    drawn = F.coalesce(kind.isin(*DRAWN_INPUTS), F.lit(False)) & (F.coalesce(value("appearance"), value("-webkit-appearance"), F.lit("auto")) != "none")
    rows = rows.withColumns({"is_inline_exception": inline, "is_ua_controlled_exception": drawn})
    small = (F.col("rendered_width_px") < least) | (F.col("rendered_height_px") < least)
    enough = (F.col("least_width_px") >= least) & (F.col("least_height_px") >= least)
    reason = F.when(F.col("is_inline_exception"), "inline").when(F.col("is_ua_controlled_exception"), "user_agent").when(enough, "size").when(small, "small")
    status = F.when(reason.isin("inline", "user_agent"), "N/A").when(reason == "size", "PASSED").when(reason == "small", "NEEDS_REVIEW")
    return rows.select("page_id", "pos", "tag", "role", "input_type", *sizes, "is_inline_exception", "is_ua_controlled_exception", status.alias("status"), reason.alias("reason"))
