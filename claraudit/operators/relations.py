"""What stands around an element: groups, labels, tables, controls, links near media, backgrounds. All by structural joins
(operators.structure), so depth doesn't matter; positions of one page meet in windows, texts are looked up by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators.structure import inside, nearest, with_of
from claraudit.sources import html
from claraudit.sources.html import attr

CONTROL_ROLES = ("button", "link", "menuitem")


def relationships(els: DataFrame, of: Column) -> DataFrame:
    """For each element where `of` holds: page_id, pos, tag, described_by (texts joined by ' | '), group_name (the first legend
    in the nearest fieldset that has one), native_label, in_data_table, in_labeled_control, in_video, and accessible_name,
    behind its group's name if there is one."""
    page = Window.partitionBy("page_id").orderBy("pos")
    after = page.rowsBetween(1, Window.unboundedFollowing)
    legend = F.first(F.when(F.col("tag") == "legend", F.col("pos")), ignorenulls=True).over(after)
    control = F.col("tag").isin("button", "a") | F.coalesce(attr("role").isin(*CONTROL_ROLES), F.lit(False))
    named = F.col("attrs").isNotNull() & (attr("aria-label").isNotNull() | attr("aria-labelledby").isNotNull() | attr("title").isNotNull() | (F.col("text") != ""))
    table = (F.col("tag") == "table") & (F.coalesce(attr("role"), F.lit("")) != "presentation")
    video = (F.col("tag") == "video") | F.coalesce(F.lower(attr("class")).rlike("video|player"), F.lit(False)) | attr("data-video-id").isNotNull()
    rows = els.withColumn("_legend", legend).withColumns({"_table": table, "_video": video, "_control": control, "_named": named})
    rows = rows.withColumn("_group", (F.col("tag") == "fieldset") & F.coalesce(F.col("_legend") <= F.col("last"), F.lit(False)))
    rows = rows.withColumns({"in_data_table": F.col("_table") | inside(F.col("_table"), "page_id"), "in_video": F.col("_video") | inside(F.col("_video"), "page_id")})
    rows = nearest(nearest(rows, F.col("_group"), "_fieldset"), F.col("_control"), "_in_control")
    own = rows.filter(of).withColumn("_at", F.when(F.col("_control"), F.col("pos")).otherwise(F.col("_in_control"))).withColumn("id", attr("id"))
    slim = rows.select("page_id", "pos", "_legend", "_named", "text", "bare")
    own = with_of(own, "_fieldset", slim, F.col("_legend").alias("_legend_at"))
    own = with_of(own, "_legend_at", slim, F.col("text").alias("group_name"))
    own = with_of(own, "_at", slim, F.col("_named").alias("_control_named"))
    own = with_of(own, "in_label", slim, F.col("text").alias("_wrapping"), F.col("bare").alias("_bare"))
    explicit = html.labels(els).groupBy("page_id", F.col("for_id").alias("id")).agg(F.first("label").alias("label"))
    described = html.resolve_refs(els, "aria-describedby", " | ").withColumnRenamed("ref_text", "described_by")
    referred = html.resolve_refs(els, "aria-labelledby")
    own = own.join(explicit, ["page_id", "id"], "left").join(described, ["page_id", "pos"], "left").join(referred, ["page_id", "pos"], "left")
    button = (F.col("tag") == "input") & F.coalesce(attr("type").isin("submit", "button", "reset"), F.lit(False))
    name = html.accessible_name(F.when(button, attr("value")), F.col("_bare"))
    label = text.first_filled(F.col("_wrapping"), F.col("label"))
    name = F.coalesce(name, label)
    group = text.blank_to_null(F.col("group_name"))
    return own.select("page_id", "pos", "tag", "id", "described_by", group.alias("group_name"), label.alias("native_label"), "in_data_table", F.coalesce("_control_named", F.lit(False)).alias("in_labeled_control"), "in_video", F.when(group.isNotNull() & name.isNotNull(), F.concat(group, F.lit(": "), name)).otherwise(name).alias("accessible_name"))


def media_context(els: DataFrame, reach: int = 3, most: int = 500) -> DataFrame:
    """media() with what stands near: links (texts and addresses) and details within the `reach` nearest ancestors, each once
    in page order, and the parent's text."""
    own = html.media(els)
    slim = els.select("page_id", "pos", "last", "ancestors", "text")
    around = els.filter(F.col("tag").isin("audio", "video")).select("page_id", "pos", F.get("ancestors", F.lit(0)).alias("_parent"), F.get("ancestors", F.least(F.lit(reach), F.size("ancestors")) - 1).alias("_box"))
    boxes = with_of(with_of(around, "_box", slim, F.col("last").alias("_end")), "_parent", slim, F.substring("text", 1, most).alias("nearby_text"))
    # the outermost of the nearest ancestors holds all of them: links lie in its interval
    others = els.filter(F.col("tag").isin("a", "details")).select("page_id", F.col("pos").alias("_at"), F.col("tag").alias("_tag"), "text", attr("href").alias("href"))
    met = boxes.join(others, "page_id").filter("_box < _at and _at <= _end")
    one = lambda tag, x: F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("_tag") == tag, F.struct("_at", x.alias("x"))))), lambda y: y["x"]))
    near = met.groupBy("page_id", "pos").agg(one("a", F.concat_ws(" ", "text", "href")).alias("links"), one("details", F.col("text")).alias("details"))
    none = F.array().cast("array<string>")
    rows = own.join(boxes.select("page_id", "pos", "nearby_text"), ["page_id", "pos"], "left").join(near, ["page_id", "pos"], "left")
    return rows.withColumns({"links": F.coalesce("links", none), "details": F.coalesce("details", none)})


def backgrounds(styled: DataFrame) -> DataFrame:
    """page_id, pos, tag, background: the colour of the nearest element, itself included, that has one, else white."""
    from claraudit.sources.css import value

    own = F.coalesce(value("background-color"), F.regexp_extract(value("background", ""), r"^\s*(#[0-9a-f]{3,8}|rgba?\([^)]*\)|[a-z]+)\s*$", 1))
    clear = (own == "") | own.isin("transparent", "none", "inherit", "initial", "unset") | own.rlike(r"rgba\([^)]*,\s*0(\.0+)?\s*\)")
    rows = styled.withColumn("_own", F.when(~clear, own))
    rows = nearest(rows, F.col("_own").isNotNull(), "_from")
    rows = with_of(rows, "_from", styled.withColumn("_own", F.when(~clear, own)), F.col("_own").alias("_behind"))
    return rows.select("page_id", "pos", "tag", F.coalesce("_own", "_behind", F.lit("rgb(255, 255, 255)")).alias("background"))


# Words of help links, and names of help widgets.
HELP = r"(?i)help|support|contact|faq|お問い合わせ|問い合わせ|ヘルプ|サポート|よくある質問"
WIDGET = r"(?i)chat|intercom|zendesk|drift-widget|helpscout|crisp-client|tawk|smarthr-help|tayori"
PHONE = r"\+?\d[\d\s\-().]{7,}\d"


def help_mechanisms(els: DataFrame) -> DataFrame:
    """page_id, pos, kind (link, phone, mail, widget), place (header, footer, nav or body): where a page offers help."""
    role = lambda *r: F.coalesce(attr("role").isin(*r), F.lit(False))
    rows = els
    for name, of in (("header", (F.col("tag") == "header") | role("banner")), ("footer", (F.col("tag") == "footer") | role("contentinfo")), ("nav", (F.col("tag") == "nav") | role("navigation"))):
        rows = rows.withColumn(f"_{name}", of | inside(of, "page_id"))
    href = F.coalesce(attr("href"), F.lit(""))
    control = F.col("tag").isin("a", "button") | role("link", "button")
    words = F.concat_ws(" ", F.col("text"), attr("aria-label"), href)
    widget = F.coalesce(F.concat_ws(" ", attr("id"), attr("class")).rlike(WIDGET), F.lit(False)) | ((F.col("tag") == "iframe") & F.coalesce(attr("src").rlike("chat|support"), F.lit(False)))
    link = F.col("tag") == "a"
    kinds = F.array_compact(F.array(F.when(link & (F.startswith(href, F.lit("tel:")) | F.col("text").rlike(PHONE)), "phone"), F.when(link & F.startswith(href, F.lit("mailto:")), "mail"), F.when(control & words.rlike(HELP), "link"), F.when(widget, "widget")))
    place = F.when(F.col("_header"), "header").when(F.col("_footer"), "footer").when(F.col("_nav"), "nav").otherwise("body")
    return rows.select("page_id", "pos", F.explode(kinds).alias("kind"), place.alias("place"))


def consistent_help(pages: DataFrame, mechanisms: DataFrame, site: Column) -> DataFrame:
    """3.2.6 over whole sites: page_id, site, kinds (in the page's order), status and departs. Every two kinds of help have an
    order and each kind has a place on most pages of a site; a page that turns an order round, or moves a kind, departs.
    Pages without help are incomplete. Sites are summed up by pairs of kinds, so no site is gathered."""
    where = pages.select("page_id", site.alias("site"))
    firsts = mechanisms.groupBy("page_id", "kind").agg(F.min(F.struct("pos", "place")).alias("f")).select("page_id", "kind", "f.pos", "f.place")
    rows = firsts.join(where, "page_id")
    own = rows.groupBy("page_id", "site").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "place"))).alias("seen"))  # four at most
    pairs = F.flatten(F.transform("seen", lambda a: F.transform(F.filter("seen", lambda b: a["kind"] < b["kind"]), lambda b: F.struct(a["kind"].alias("a"), b["kind"].alias("b"), (a["pos"] < b["pos"]).alias("forward")))))
    orders = own.select("page_id", "site", F.explode(pairs).alias("p")).select("page_id", "site", "p.*")
    usual = orders.groupBy("site", "a", "b").agg(F.count_if("forward").alias("_f"), F.count(F.lit(1)).alias("_n"))
    turned = orders.join(usual, ["site", "a", "b"]).filter(F.when(F.col("forward"), F.col("_f") * 2 < F.col("_n")).otherwise(F.col("_f") * 2 > F.col("_n")))
    turned = turned.select("page_id", F.concat(F.lit("order:"), "a", F.lit("-"), "b").alias("why"))
    places = rows.groupBy("site", "kind", "place").agg(F.count(F.lit(1)).alias("_n")).groupBy("site", "kind").agg(F.max("_n").alias("_most"), F.sum("_n").alias("_all"), F.max_by("place", F.struct("_n", "place")).alias("_place"))
    moved = rows.join(places.filter("_most * 2 > _all"), ["site", "kind"]).filter("place <> _place").select("page_id", F.concat(F.lit("place:"), "kind").alias("why"))
    departs = turned.unionByName(moved).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("departs"))
    out = where.join(own.select("page_id", F.array_join(F.transform("seen", lambda x: x["kind"]), ",").alias("kinds")), "page_id", "left").join(departs, "page_id", "left")
    status = F.when(F.col("kinds").isNull(), "incomplete").when(F.col("departs").isNotNull(), "fail").otherwise("pass")
    return out.select("page_id", "site", F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("departs", F.lit("")).alias("departs"), status.alias("status"))
