"""Style sheets of raw pages: rules as rows, their selectors matched with elements by joins, and the cascade.

A sheet's text is parsed in Arrow batches; that is the only Python here. A selector becomes steps, from left to right. Each
step has a key, the id, class or tag that an element must have, so steps meet elements by an equality join on (page, key) and
are then tested in full. Steps are chained from left to right by one window each: descendants lie in the interval of a
match of the step before, children and siblings share its place, so ancestors are found however far.

Known: type, id, class and attribute selectors, the four combinators, :root, :first-child, :last-child, :link, @media with
widths, heights and orientation, @supports and @layer (taken to hold). Selectors with other pseudo-classes or with
pseudo-elements speak of states that raw markup has not and match nothing. Shorthands of what the checks read (flex-flow,
animation, grid placement) are spelt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claraudit.sources.html import attr, elements, few
from claraudit.sources.stage import kept

#: Width and height that media conditions are held against.
VIEWPORT = (1280, 720)
_DECLARED = "array<struct<property:string,value:string,important:boolean>>"
_STEP = "struct<comb:string,key:string,tag:string,id:string,classes:array<string>,attrs:array<struct<name:string,op:string,value:string>>,pseudo:array<string>>"
RULE = f"page_id long, pos int, rule int, selector string, steps array<{_STEP}>, weight int, media array<string>, applies boolean, declared {_DECLARED}, css string"
_TOKEN = re.compile(r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[{};()]|[^{};()"']+""", re.S)
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_SIMPLE = re.compile(rf"(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*)\]|(?P<pseudo>::?[\w-]+(?:\([^)]*\))?)")
_COMB = re.compile(r"\s*([>+~])\s*|\s+")
_ATTR = re.compile(r"""\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?\s*[iIsS]?\s*\Z""")
_FEATURE = re.compile(r"\(\s*(min-|max-)?(width|height|orientation)\s*:\s*([\d.]+px|portrait|landscape)\s*\)", re.I)
_GROUPS = ("@media", "@supports", "@layer", "@container")


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside strings, brackets and parentheses."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[()\[\]]|""" + re.escape(mark), text):
        x = m[0]
        if x in "([":
            depth += 1
        elif x in ")]":
            depth = max(0, depth - 1)
        elif x == mark and not depth:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def _longhands(name: str, value: str) -> list[tuple[str, str]]:
    """A shorthand's parts that checks read, or the declaration itself."""
    if name == "flex-flow":
        return [("flex-direction", next((x for x in value.split() if x.startswith(("row", "column"))), "row"))]
    if name in ("grid-row", "grid-column"):
        return [(f"{name}-start", value.split("/")[0].strip())]
    if name == "padding":
        sides = (value.split() * 4)[:4] if len(value.split()) in (1, 2) else [*value.split(), *value.split()[1:2]][:4]
        return [(f"padding-{side}", x) for side, x in zip(("top", "right", "bottom", "left"), sides, strict=False)]
    if name == "grid-area":
        parts = [x.strip() for x in value.split("/")]
        return [("grid-row-start", parts[0]), ("grid-column-start", parts[1] if len(parts) > 1 else parts[0] if not parts[0][:1].isdigit() else "auto")]
    if name in ("animation", "-webkit-animation"):
        names, times, counts, states = [], [], [], []
        for one in _split(value, ","):
            found = {"name": "none", "time": "0s", "count": "1", "state": "running"}
            spans = 0
            for x in _split(" ".join(one.split()), " "):
                low = x.lower()
                if re.fullmatch(r"[\d.]+m?s", low):
                    spans += 1
                    found |= {"time": low} if spans == 1 else {}
                elif low == "infinite" or re.fullmatch(r"[\d.]+", low):
                    found["count"] = low
                elif low in ("running", "paused"):
                    found["state"] = low
                elif x and "(" not in x and low not in _WORDS:
                    found["name"] = x
            for list_, key in ((names, "name"), (times, "time"), (counts, "count"), (states, "state")):
                list_.append(found[key])
        return [("animation-name", ", ".join(names)), ("animation-duration", ", ".join(times)), ("animation-iteration-count", ", ".join(counts)), ("animation-play-state", ", ".join(states))]
    return [(name, value)]


# Words of the animation shorthand that are no names.
_WORDS = frozenset("ease linear ease-in ease-out ease-in-out step-start step-end normal reverse alternate alternate-reverse none forwards backwards both initial inherit unset".split())


def declarations(text: str) -> list[dict]:
    out = []
    for part in _split(text, ";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), " ".join(value.split())
        if not colon or not name or not value or re.search(r"[\s{}]", name):
            continue
        important = bool(re.search(r"!\s*important$", value, re.I))
        value = re.sub(r"\s*!\s*important$", "", value, flags=re.I)
        out += [{"property": n, "value": v, "important": important} for n, v in _longhands(name, value)]
    return out


def split_selectors(text: str) -> list[str]:
    """The selectors of a list."""
    return [s.strip() for s in _split(text, ",")]


def steps_of(selector: str) -> tuple[list[dict], int] | None:
    """(steps, weight) of one selector, None for those that match nothing here."""
    at, out, comb, counts = 0, [], "", [0, 0, 0]
    text = selector.strip()
    while at < len(text):
        step = {"comb": comb, "key": "*", "tag": None, "id": None, "classes": [], "attrs": [], "pseudo": []}
        start = at
        while m := _SIMPLE.match(text, at):
            at = m.end()
            clean = lambda x: re.sub(r"\\(.)", r"\1", x)
            if m["tag"]:
                if m.start() != start:
                    return None
                step["tag"] = None if m["tag"] == "*" else m["tag"].lower()
                counts[2] += m["tag"] != "*"
            elif m["id"]:
                step["id"] = clean(m["id"])
                counts[0] += 1
            elif m["cls"]:
                step["classes"].append(clean(m["cls"]))
                counts[1] += 1
            elif m["attr"] is not None:
                a = _ATTR.match(m["attr"])
                if not a:
                    return None
                step["attrs"].append({"name": a[1].lower(), "op": a[2] or "", "value": next((x for x in a.groups()[2:] if x is not None), "")})
                counts[1] += 1
            else:
                if m["pseudo"].lower() not in (":root", ":first-child", ":last-child", ":link", ":any-link"):
                    return None
                step["pseudo"].append(m["pseudo"].lower())
                counts[1] += 1
        if at == start:
            return None
        step["key"] = "#" + step["id"] if step["id"] else "." + step["classes"][0] if step["classes"] else step["tag"] or "*"
        out.append(step)
        if at < len(text):
            c = _COMB.match(text, at)
            if not c:
                return None
            comb, at = c[1] or " ", c.end()
            if at == len(text):
                return None
    a, b, c = (min(x, 1023) for x in counts)
    return (out, a << 20 | b << 10 | c) if out else None


def media_holds(condition: str, width: int, height: int) -> bool:
    """Of a list of queries one holds: screen or all, sizes in pixels, orientation; what isn't known doesn't hold."""

    def one(query: str) -> bool:
        words = re.sub(r"\([^)]*\)", " ", query.lower())
        if re.search(r"\b(not|print|speech)\b", words) or re.search(r"\b(?!and\b|only\b|screen\b|all\b)[a-z-]+", words):
            return False
        features = _FEATURE.findall(query)
        if len(features) != query.count("("):
            return False
        for bound, name, value in features:
            value = value.lower()
            if name.lower() == "orientation":
                holds = value == ("landscape" if width > height else "portrait")
            else:
                have = width if name.lower() == "width" else height
                size = float(value[:-2]) if value.endswith("px") else -1.0
                holds = have >= size if bound.lower() == "min-" else have <= size if bound.lower() == "max-" else have == size
            if not holds:
                return False
        return True

    return any(one(q) for q in _split(condition, ","))


def parse_sheet(text: str, viewport: tuple[int, int] = VIEWPORT, media: str = "") -> list[dict]:
    """Rules in order, one for each selector of a list; media: the conditions around it, outermost first."""
    text = re.sub(r"/\*.*?(\*/|\Z)", " ", text.replace("<!--", " ").replace("-->", " "), flags=re.S)
    out, stack, buffer, depth, number = [], [], [], 0, 0
    around = [f"@media {media}"] if media and media.strip().lower() not in ("all", "screen") else []
    for m in _TOKEN.finditer(text):
        x = m[0]
        if x == "(":
            depth += 1
        elif x == ")":
            depth = max(0, depth - 1)
        if x == "{":
            depth = 0
            head = " ".join("".join(buffer).split())
            kind = "group" if head.lower().startswith(_GROUPS) else "skip" if head.startswith("@") or any(k != "group" for k, _ in stack) else "style"
            stack.append((kind, head))
            buffer = []
        elif x == "}":
            depth = 0
            if stack:
                kind, head = stack.pop()
                if kind == "style":
                    number += 1
                    own = declarations("".join(buffer))
                    conditions = [*around, *[h for _, h in stack]]
                    holds = all(media_holds(c[6:], *viewport) for c in conditions if c.lower().startswith("@media"))
                    for s in _split(head, ","):
                        steps = steps_of(s)
                        spelt = f"{s.strip()} {{ {' '.join(f'{d["property"]}: {d["value"]};' for d in own)} }}"
                        out.append({"rule": number, "selector": s.strip(), "steps": steps[0] if steps else None, "weight": steps[1] if steps else 0, "media": conditions, "applies": holds, "declared": own, "css": spelt})
            buffer = []
        elif x == ";" and not depth and not (stack and stack[-1][0] == "style"):
            buffer = []
        else:
            buffer.append(x)
    return out


_TEXTS = pa.list_(pa.string())
_ARROW_STEP = pa.struct([("comb", pa.string()), ("key", pa.string()), ("tag", pa.string()), ("id", pa.string()), ("classes", _TEXTS), ("attrs", pa.list_(pa.struct([(c, pa.string()) for c in ("name", "op", "value")]))), ("pseudo", _TEXTS)])
ARROW = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("rule", pa.int32()), ("selector", pa.string()), ("steps", pa.list_(_ARROW_STEP)), ("weight", pa.int32()), ("media", _TEXTS), ("applies", pa.bool_()), ("declared", pa.list_(pa.struct([("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))), ("css", pa.string())])


def _rules(viewport: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, pos, media, text, inline in few(batch):
                if inline:
                    rows = [{"rule": 0, "selector": None, "steps": None, "weight": 1 << 30, "media": [], "applies": True, "declared": declarations(text), "css": text}]
                else:
                    rows = parse_sheet(text, viewport, media or "")
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"page_id": page, "pos": pos} for r in rows], ARROW)

    return run


def rules(els: DataFrame, viewport: tuple[int, int] = VIEWPORT) -> DataFrame:
    """A row for each selector of each page's sheets; pos is that of the style element, or, without a selector, that of the
    element that the style attribute belongs to."""
    sheets = els.filter("tag = 'style' and content is not null").select("page_id", "pos", attr("media").alias("media"), F.col("content").alias("text"), F.lit(False).alias("inline"))
    own = els.filter(attr("style").isNotNull()).select("page_id", "pos", F.lit(None).cast("string").alias("media"), attr("style").alias("text"), F.lit(True).alias("inline"))
    return sheets.unionByName(own).mapInArrow(_rules(viewport), RULE)


def placed(els: DataFrame) -> DataFrame:
    """Elements with parent, prev and next (siblings' positions), classes and id."""
    siblings = Window.partitionBy("page_id", "parent").orderBy("pos")
    rows = els.withColumn("parent", F.get("ancestors", F.lit(0)))
    classes = F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != "")
    return rows.withColumns({"prev": F.lag("pos").over(siblings), "next": F.lead("pos").over(siblings), "classes": classes, "id": attr("id")})


def _has_attr(a: Column) -> Column:
    have, want, op = F.element_at("attrs", a["name"]), a["value"], a["op"]
    some = want != ""
    return F.coalesce(
        F.when(op == "", have.isNotNull()).when(op == "=", have == want).when(op == "~=", F.array_contains(F.split(have, r"\s+"), want)).when(op == "|=", (have == want) | F.startswith(have, F.concat(want, F.lit("-"))))
        .when(op == "^=", some & F.startswith(have, want)).when(op == "$=", some & F.endswith(have, want)).when(op == "*=", some & F.contains(have, want)),
        F.lit(False),
    )


def _pseudo(p: Column) -> Column:
    return F.when(p == ":root", F.col("tag") == "html").when(p == ":first-child", F.col("prev").isNull()).when(p == ":last-child", F.col("next").isNull()).otherwise(attr("href").isNotNull() & F.col("tag").isin("a", "area"))


def _fits() -> Column:
    """Whether an element fits a step by itself."""
    s = F.col("step")
    same = (s["tag"].isNull() | (s["tag"] == F.col("tag"))) & (s["id"].isNull() | F.coalesce(s["id"] == F.col("id"), F.lit(False)))
    return same & (F.size(F.array_except(s["classes"], F.col("classes"))) == 0) & F.forall(s["attrs"], _has_attr) & F.forall(s["pseudo"], _pseudo)


def matches(els: DataFrame, sheet: DataFrame, most_steps: int | None = None) -> DataFrame:
    """page_id, pos (of the element), and the rule's sheet (position), rule, selector, weight, declared. els: placed().
    most_steps: of the longest selector, asked from the sheet where it isn't given."""
    own = sheet.filter("steps is not null").select("page_id", F.col("pos").alias("sheet"), "rule", "selector", "steps", "weight", "declared")
    steps = own.select("page_id", "sheet", "rule", "selector", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "step"))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(F.lit("*"), F.col("tag"), F.concat(F.lit("#"), F.col("id"))), F.transform("classes", lambda c: F.concat(F.lit("."), c)))))
    slim = els.select("page_id", "pos", "last", "parent", "prev", "next", "tag", "id", "attrs", "classes", F.explode(keys).alias("key"))
    fit = steps.withColumn("key", F.col("step.key")).join(slim, ["page_id", "key"]).filter(_fits())
    fit = fit.select("page_id", "sheet", "rule", "selector", "n", "i", F.col("step.comb").alias("comb"), "pos", "last", "parent", "prev")
    if most_steps is None:
        most_steps = own.agg(F.max(F.size("steps"))).first()[0] or 1
    if most_steps > 1:  # read once for each step
        fit = kept(fit, "matches")
    found = fit.filter("i = 0")
    by = ["page_id", "sheet", "rule", "selector", "n"]
    whole = found.filter("n = 1").select(*by, "pos")
    for i in range(1, most_steps):
        # what comes before this step and what fits it, side by side where its combinator lets them meet
        here = fit.filter(F.col("i") == i)
        comb = own.select("page_id", "sheet", "rule", "selector", F.get("steps", F.lit(i))["comb"].alias("comb")).distinct()
        before = found.drop("comb").join(comb.filter("comb is not null"), ["page_id", "sheet", "rule", "selector"])
        place = lambda child: F.when(F.col("comb") == " ", 0).when(F.col("comb") == "~", F.coalesce("parent", F.lit(-1))).otherwise(child)
        asks = here.withColumn("_is", F.lit(False)).withColumn("_place", place(F.when(F.col("comb") == ">", F.col("parent")).otherwise(F.col("prev"))))
        gives = before.select(*here.columns).withColumn("_is", F.lit(True)).withColumn("_place", place(F.col("pos")))
        so_far = Window.partitionBy("page_id", "sheet", "rule", "selector", "_place").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
        reach = F.max(F.when(F.col("_is"), F.col("last"))).over(so_far)
        good = F.when(F.col("comb") == " ", reach >= F.col("pos")).otherwise(reach.isNotNull())
        found = asks.unionByName(gives).withColumn("_good", good).filter("not _is and _good and _place is not null").select(*here.columns)
        whole = whole.unionByName(found.filter(F.col("n") == i + 1).select(*by, "pos"))
    return whole.drop("n").join(own.drop("steps"), ["page_id", "sheet", "rule", "selector"])


def styles(els: DataFrame, sheet: DataFrame, most_steps: int | None = None) -> DataFrame:
    """page_id, pos, css: map of the declared values that win, by importance, style attribute, weight and order."""
    from_rules = matches(els, sheet.filter("applies"), most_steps).select("page_id", "pos", "weight", "sheet", "rule", "declared")
    own = sheet.filter("selector is null").select("page_id", "pos", "weight", F.lit(0).alias("sheet"), F.lit(0).alias("rule"), "declared")
    rows = from_rules.unionByName(own).select("page_id", "pos", "weight", "sheet", "rule", F.posexplode("declared").alias("i", "d"))
    rank = F.struct(F.col("d.important"), "weight", "sheet", "rule", "i")
    won = rows.groupBy("page_id", "pos", F.col("d.property").alias("property")).agg(F.max_by("d.value", rank).alias("value"))
    return won.groupBy("page_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("css"))


def styled(els: DataFrame, sheet: DataFrame, most_steps: int | None = None) -> DataFrame:
    """placed() elements with css, an empty map where nothing is declared."""
    rows = placed(els)
    return rows.join(styles(rows, sheet, most_steps), ["page_id", "pos"], "left").withColumn("css", F.coalesce("css", F.create_map().cast("map<string,string>")))


def read(pages: DataFrame, viewport: tuple[int, int] = VIEWPORT) -> tuple[DataFrame, DataFrame]:
    """(styled elements, rules) of raw pages. Pages are parsed once: elements, rules and styles are kept as tables, as every
    check reads them several times."""
    els = kept(elements(pages), "elements")
    sheet = kept(rules(els, viewport), "rules")
    return kept(styled(els, sheet), "styled"), sheet


def value(name: str, default: str | None = None) -> Column:
    v = F.lower(F.element_at("css", name))
    return v if default is None else F.coalesce(v, F.lit(default))
