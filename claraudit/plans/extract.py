"""The tables that an audit's rules read, made from raw pages: pages are parsed once and kept, everything else is an
expression or a join over their elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claraudit.functions import text
from claraudit.operators import layout, relations
from claraudit.plans.audit import rule
from claraudit.sources import css, html, scripts
from claraudit.sources.html import attr

C = F.col


def _of_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the address of their page and their place as a selector."""
    there = pages.select(C("page_id").alias("_page"), C("url").alias("page_url"))
    out = rows.join(there, C("page_id") == C("_page")).drop("_page")
    return out.withColumn("selector", F.concat("tag", F.lit(":"), C("pos").cast("string"))) if {"tag", "pos"} <= set(rows.columns) else out


def _media(els: DataFrame) -> DataFrame:
    rows = relations.media_context(els)
    link = F.array_join("links", " ")
    track = F.exists("tracks", lambda t: F.coalesce(t["kind"], F.lit("")).isin("captions", "subtitles", "descriptions"))
    own = els.select("page_id", "pos", attr("aria-hidden").alias("_hidden"))
    rows = rows.join(own, ["page_id", "pos"])
    return rows.select("page_id", "pos", "tag", C("tag").alias("kind"), "src", "muted", "loop", "autoplay", "controls", track.alias("has_track"), F.concat_ws(" ", link, F.array_join("details", " ")).alias("link_text"), F.lit(None).cast("string").alias("described_by"), F.lit(None).cast("boolean").alias("is_labelled_alternative"), F.coalesce(C("_hidden") == "true", F.lit(False)).alias("is_decorative"))


def _moving(els: DataFrame, styled: DataFrame) -> DataFrame:
    """Moving content of markup (as far as it starts by itself) and of style sheets."""
    marked = html.moving(els).filter("content_type in ('marquee', 'blink')").select("page_id", "pos", "tag", "content_type", F.lit(-1.0).alias("duration_seconds"), F.lit("infinite").alias("iteration_count"), F.lit(True).alias("loops"), F.lit(False).alias("has_mechanism"), F.lit(None).cast("string").alias("exception"))
    own = html.media(els).filter("autoplay and tag = 'video'").select("page_id", "pos", "tag", F.lit("video").alias("content_type"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(None).cast("string").alias("iteration_count"), "loop", "controls")
    video = own.select(*own.columns[:6], C("loop").alias("loops"), C("controls").alias("has_mechanism"), F.lit(None).cast("string").alias("exception"))
    animated = layout.animations(styled).select("page_id", "pos", "tag", F.lit("css_animation").alias("content_type"), "duration_seconds", C("iterations").alias("iteration_count"), "loops", "has_mechanism", "exception")
    rows = marked.unionByName(video).unionByName(animated)
    return rows.withColumns({"starts_automatically": F.lit(True), "duration_known": C("duration_seconds").isNotNull()})


def page_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """Tables by the names that rules ask for: form_field, interactive, media, moving_content, text_block, and the styled
    elements, style rules and handlers that rules over whole pages read. pages: page_id, url, html."""
    pages = pages.select(C("page_id").cast("long"), "url", "html")
    styled, sheet = css.read(pages)
    els = styled.drop("parent", "prev", "next", "classes", "id", "css")
    at = lambda rows: _of_page(rows, pages)
    names: Column = lambda c: text.collapse(F.lower(F.coalesce(C(c), F.lit(""))))
    controls = html.interactive(els)
    return {
        "pages": pages,
        "form_field": at(html.forms(els)),
        "interactive": at(controls.select("page_id", "pos", "tag", names("visible_label").alias("label"), names("accessible_name").alias("name"))),
        "media": at(_media(els)),
        "moving_content": at(_moving(els, styled)),
        "text_block": at(html.sensory(els)),
        "styled": at(styled),
        "style_rule": sheet,
        "page_handler": scripts.handlers(styled, scripts.listeners(els)),
    }


def _per_page(found: DataFrame, styled: DataFrame, failed: str) -> DataFrame:
    """A row for each finding, and one that passes for each page without any."""
    urls = styled.select("page_id", "page_url").distinct()
    hits = found.join(urls, "page_id").withColumn("status", F.coalesce(*([C("status")] if "status" in found.columns else []), F.lit(failed)))
    clean = urls.join(found.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "page_url", F.lit("PASSED").alias("status"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("selector"))
    reason = next((c for c in ("reason", "code", "kind", "detail") if c in hits.columns), None)
    place = F.concat("tag", F.lit(":"), C("pos").cast("string")) if {"tag", "pos"} <= set(hits.columns) else C("target") if "target" in hits.columns else C("pos").cast("string")
    return hits.select("page_id", "page_url", "status", (C(reason) if reason else F.lit("")).alias("reason"), place.alias("selector")).unionByName(clean)


def _register() -> None:
    from claraudit.operators import behaviour

    rule("reading_order", "1.3.2", "styled")(lambda styled: _per_page(layout.reordered(styled), styled, "NEEDS_REVIEW"))
    rule("orientation_markup", "1.3.4", "styled", "style_rule", "pages")(lambda styled, sheet, pages: _per_page(layout.orientation(styled, sheet, pages), styled, "NEEDS_REVIEW"))
    rule("char_keys_page", "2.1.4", "styled", "page_handler")(lambda styled, own: _per_page(behaviour.character_keys(styled, own), styled, "NEEDS_REVIEW"))
    rule("pointer_cancel_page", "2.5.2", "styled", "page_handler")(lambda styled, own: _per_page(behaviour.pointer_cancellation(styled, own), styled, "NEEDS_REVIEW"))
    rule("dragging_page", "2.5.7", "styled", "page_handler")(lambda styled, own: _per_page(behaviour.dragging(styled, own).filter("not alternative"), styled, "NEEDS_REVIEW"))
    rule("status_messages_page", "4.1.3", "styled")(lambda styled: behaviour.status_messages(styled).join(styled.select("page_id", "page_url").distinct(), "page_id").select("page_id", "page_url", "status", C("contexts").alias("reason")))
    rule("target_size_page", "2.5.8", "styled")(lambda styled: _per_page(layout.targets(styled).filter("reason = 'small'"), styled, "NEEDS_REVIEW"))
    rule("help_order", "3.2.6", "styled", "pages")(lambda styled, pages: _help(styled, pages))


def _help(styled: DataFrame, pages: DataFrame) -> DataFrame:
    from claraudit.functions import urls

    found = relations.consistent_help(pages, relations.help_mechanisms(styled), urls.host(C("url")))
    return found.join(pages.select("page_id", C("url").alias("page_url")), "page_id").select("page_id", "page_url", "status", C("departs").alias("reason"))


_register()
