"""Checks of how elements behave, from markup and the listeners of inline scripts: character keys, down events, dragging,
status messages. Elements are those of sources.css.placed(), handlers those of sources.scripts.handlers()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.operators.structure import inside, with_of
from claraudit.sources.html import attr

# Keys that are characters, what reads one in a handler, and modifiers that guard it.
CHARACTER = r"^[a-zA-Z!-/:-@\[-`{-~]$"
READS_KEY = r"(?:\.key|\.code)\s*(?:\.toLowerCase\s*\(\s*\))?\s*===?\s*['\"][a-zA-Z!-/:-@\[\-`{-~]['\"]|keyCode\s*===?\s*(?:6[5-9]|[7-8]\d|90)"
MODIFIER = "ctrlKey|altKey|metaKey"
# What acts in a handler, and handlers that don't.
ACTS = r"(?i)submit|navigate|redirect|window\.location|document\.location|fetch|ajax|delete|save|send"
TRIVIAL = r"^return\s+false\s*;?$"
VISUAL = r"^\s*(this\s*\.\s*style|event\s*\.\s*preventDefault\s*\(\s*\))\s*;?\s*$"
DOWN, UP, MOVE = ("mousedown", "pointerdown", "pointermove", "touchstart"), ("mouseup", "pointerup", "click", "touchend"), ("pointermove", "touchmove", "drag")
# Markers of libraries for dragging.
DRAG_MARKS, DRAG_CLASSES = ("data-rbd-draggable-id", "data-dnd-kit-draggable", "data-sortable", "data-interact", "data-drag-handle"), ("sortable-item", "ui-draggable", "gu-transit")
# Words that show parts that change, in English and Japanese.
RESULTS, COUNTS, CARTS = "(?i)result|結果", "(?i)count|counter|notification|unread|新着|件|通知|未読", "(?i)cart|basket|カート|買い物かご"
NOTICES = "(?i)notification|toast|snackbar|flash|alert|banner"


def _bodies(handlers: DataFrame, events: tuple[str, ...], name: str) -> DataFrame:
    """page_id, pos and the element's handlers of the events, joined, in the order of the events."""
    own = handlers.filter(F.col("pos").isNotNull() & F.col("event").isin(*events))
    place = F.array_position(F.array(*[F.lit(e) for e in events]), F.col("event"))
    return own.groupBy("page_id", "pos").agg(F.trim(F.concat_ws(" ", F.transform(F.array_sort(F.collect_set(F.struct(place, "body"))), lambda x: x["body"]))).alias(name))


def _unguarded(body: str, within: int) -> Column:
    """A character key is read and no modifier is asked for near."""
    key, modifier = F.regexp_instr(body, F.lit(READS_KEY)), F.regexp_instr(body, F.lit(MODIFIER))
    return (key > 0) & ~((modifier > 0) & (F.abs(key - modifier) <= within))


def character_keys(els: DataFrame, handlers: DataFrame) -> DataFrame:
    """2.1.4: page_id, pos, kind (accesskey, inline-handler, script-listener), detail."""
    key = F.trim(attr("accesskey"))
    access = els.filter(key.rlike(CHARACTER)).select("page_id", "pos", F.lit("accesskey").alias("kind"), key.alias("detail"))
    inline = _bodies(handlers.filter("source = 'inline'"), ("keydown", "keypress", "keyup"), "body").filter(_unguarded("body", 120))
    script = handlers.filter((F.col("source") == "script") & F.col("event").isin("keydown", "keypress", "keyup")).filter(_unguarded("body", 200))
    shown = F.regexp_extract("body", READS_KEY, 0).alias("detail")
    return access.unionByName(inline.select("page_id", "pos", F.lit("inline-handler").alias("kind"), shown)).unionByName(script.select("page_id", "pos", F.lit("script-listener").alias("kind"), shown))


def pointer_cancellation(els: DataFrame, handlers: DataFrame) -> DataFrame:
    """2.5.2: page_id, pos, tag of elements that act on the down event and have no way back."""
    down = _bodies(handlers, DOWN, "body")
    up = handlers.filter(F.col("pos").isNotNull() & F.col("event").isin(*UP)).select("page_id", "pos").distinct()
    field = ((F.col("tag") == "input") & F.lower(F.coalesce(attr("type"), F.lit("text"))).isin("text", "email", "password", "search", "tel", "url", "number")) | (F.col("tag") == "textarea")
    acting = down.filter((F.length("body") >= 5) & ~F.col("body").rlike(TRIVIAL) & ~F.col("body").rlike(VISUAL) & F.col("body").rlike(ACTS))
    return acting.join(up, ["page_id", "pos"], "left_anti").join(els.filter(~field).select("page_id", "pos", "tag"), ["page_id", "pos"]).select("page_id", "pos", "tag")


def dragging(els: DataFrame, handlers: DataFrame) -> DataFrame:
    """2.5.7: page_id, pos, kind (native, handler, pointer, library), alternative: whether a control lies in the element or in
    its parent. Controls are counted along the page, so an interval's are a difference of two counts."""
    control = (F.col("tag") == "button") | F.coalesce(attr("role") == "button", F.lit(False)) | ((F.col("tag") == "a") & attr("href").isNotNull()) | ((F.col("tag") == "input") & F.coalesce(attr("type").isin("button", "submit"), F.lit(False)))
    per = handlers.filter("pos is not null").groupBy("page_id", "pos").agg(F.collect_set("event").alias("events"))
    so_far = F.sum(control.cast("int")).over(Window.partitionBy("page_id").orderBy("pos"))
    rows = els.withColumn("_c", so_far)
    counts = rows.select("page_id", "pos", "last", "_c")
    own = rows.join(per, ["page_id", "pos"], "left")
    has = lambda *e: F.coalesce(F.arrays_overlap("events", F.array(*[F.lit(x) for x in e])), F.lit(False))
    marked = F.lit(False)
    for m in DRAG_MARKS:
        marked = marked | (attr(m).isNotNull() if m != "data-rbd-draggable-id" else F.coalesce(F.trim(attr(m)) != "", F.lit(False)))
    marked = (marked | F.arrays_overlap("classes", F.array(*[F.lit(c) for c in DRAG_CLASSES]))) & (F.coalesce(attr("draggable"), F.lit("")) != "false") & (F.coalesce(F.trim(attr("data-rbd-draggable-id")), F.lit("x")) != "")
    kind = F.when(attr("draggable") == "true", "native").when(has("dragstart"), "handler").when(has("pointerdown", "touchstart") & has(*MOVE), "pointer").when(marked, "library")
    own = own.withColumn("kind", kind).filter("kind is not null")
    own = with_of(own, "last", counts, F.col("_c").alias("_c_last"))
    own = with_of(own, "parent", counts, F.col("_c").alias("_c_parent"), F.col("last").alias("_parent_last"))
    own = with_of(own, "_parent_last", counts, F.col("_c").alias("_c_parent_last"))
    alternative = (F.col("_c_last") > F.col("_c")) | F.coalesce(F.col("_c_parent_last") > F.col("_c_parent"), F.lit(False))
    return own.select("page_id", "pos", "kind", alternative.alias("alternative"))


def status_messages(els: DataFrame) -> DataFrame:
    """4.1.3 by page: page_id, forms, contexts (what changes: form, results, cart, notice), live (regions), not_atomic, invalid
    (fields that say so outside a live region), status."""
    role, polite = F.coalesce(attr("role"), F.lit("")), F.coalesce(attr("aria-live"), F.lit(""))
    told = role.isin("status", "alert", "log") | polite.isin("polite", "assertive")
    announced = role.isin("status", "alert", "log") | attr("aria-live").isNotNull()
    rows = els.withColumns({"_told": told | inside(told, "page_id"), "_announced": inside(announced, "page_id")})
    names = lambda *a: F.concat_ws(" ", *[attr(x) for x in a])
    badge = names("class").rlike("(?i)badge") & (F.trim("text").rlike(r"^\d+\+?$") | names("aria-label").rlike(COUNTS))
    notice = names("class").rlike(NOTICES) & ~(names("class").rlike("(?i)alert|banner") & attr("role").isNotNull()) & ~F.col("_told")
    live = attr("aria-live").isNotNull() | role.isin("status", "alert", "log", "timer", "marquee")
    urgent = (role == "alert") | (polite == "assertive")
    some = {"form": F.col("tag") == "form", "results": names("aria-label", "id", "class").rlike(RESULTS), "cart": names("aria-label", "class").rlike(CARTS) | badge, "notice": notice}
    per = rows.groupBy("page_id").agg(
        F.count_if(some["form"]).alias("forms"), F.count_if(live).alias("live"), F.array_compact(F.array(*[F.when(F.bool_or(c), k) for k, c in some.items()])).alias("_contexts"),
        F.count_if(urgent & (F.coalesce(attr("aria-atomic"), F.lit("")) != "true")).alias("not_atomic"), F.count_if(attr("aria-invalid").isNotNull() & ~F.col("_announced")).alias("invalid"),
    )
    status = F.when((F.size("_contexts") > 0) & (F.col("live") == 0), "fail").when(F.size("_contexts") > 0, "incomplete").when(F.col("live") > 0, "pass").otherwise("incomplete")
    return per.select("page_id", "forms", F.array_join("_contexts", ",").alias("contexts"), "live", "not_atomic", "invalid", status.alias("status"))
