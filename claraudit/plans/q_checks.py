"""Queries of form, handler and focus checks and of scanner results, over truth tables by the keys of `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from claraudit.functions import urls
from claraudit.operators import form_checks as fc
from claraudit.plans.registry import Records, Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
B, BN = [True, False], [True, False, None]
R = lambda **v: Records("orders", "o_orderkey", **v)


def check(name: str, records: Records, column, sql: str):
    """A check whose value is one string column; sql is the same for DuckDB."""

    @query(name, f"WITH r AS ({records.cte()}) SELECT k, {sql} AS status FROM r")
    def run(spark, sf_dir):
        return records.frame(spark, sf_dir).select("k", column().alias("status"))


_MSG = ["Invalid.", "error", "Please enter a date", "Bad", "Use 8+ characters", "wrong value", "", None, "This message is long enough to be left alone", "Nope, digits only"]
check("chk_error_suggestion", R(message=_MSG), lambda: fc.error_suggestion(F.col("message")), "CASE k % 10 WHEN 0 THEN 'fail' WHEN 1 THEN 'fail' WHEN 3 THEN 'fail' WHEN 5 THEN 'fail' WHEN 6 THEN 'incomplete' WHEN 7 THEN 'incomplete' ELSE 'pass' END")
check("chk_error_prevention", R(words=["Delete and pay", "Pay now", "Accept terms", "Search", "Review and buy"], safeguard=BN), lambda: F.concat_ws(":", fc.error_prevention(F.col("words"), F.col("safeguard"))["kind"], fc.error_prevention(F.col("words"), F.col("safeguard"))["status"]),
      "CASE WHEN words = 'Search' THEN 'pass' ELSE CASE words WHEN 'Delete and pay' THEN 'destructive' WHEN 'Accept terms' THEN 'legal' ELSE 'financial' END || ':' || CASE WHEN safeguard IS TRUE OR words LIKE 'Review%' THEN 'pass' ELSE 'fail' END END")
check("fn_process_type", R(form=["newsletter", "order and contact", "hello", "予約"], field=["email", "apply for a job", "sign-up"]), lambda: fc.process_type(F.col("form"), F.col("field")),
      "CASE form WHEN 'newsletter' THEN 'subscribe' WHEN '予約' THEN 'booking' ELSE CASE field WHEN 'apply for a job' THEN 'application' WHEN 'sign-up' THEN 'account' ELSE CASE form WHEN 'hello' THEN 'unknown' ELSE 'contact' END END END")
check("chk_images_of_text", R(alt=["Big summer sale starts now.", "Logo", "", "a cat", "Our new store opens"], src=["/img/banner1.png", "/img/x.png"], **{"class": ["hero-text", None]}, role=[None, "none"]), lambda: fc.images_of_text(),
      "CASE WHEN alt IN ('', 'Logo') OR role = 'none' THEN 'skipped' ELSE CASE WHEN s >= 3 THEN 'fail' WHEN s = 2 THEN 'incomplete' ELSE 'pass' END END".replace("s >=", "(CASE WHEN src LIKE '%banner%' THEN 2 ELSE 0 END + CASE WHEN \"class\" IS NOT NULL THEN 1 ELSE 0 END + CASE alt WHEN 'Big summer sale starts now.' THEN 2 WHEN 'Our new store opens' THEN 1 ELSE 0 END) >=").replace("s = 2", "(CASE WHEN src LIKE '%banner%' THEN 2 ELSE 0 END + CASE WHEN \"class\" IS NOT NULL THEN 1 ELSE 0 END + CASE alt WHEN 'Big summer sale starts now.' THEN 2 WHEN 'Our new store opens' THEN 1 ELSE 0 END) = 2"))
check("chk_use_of_color", R(link_color=["#000000", "#0000ff", "#0f0f0f"], text_color=["#000", "#101010"], underlined=BN, bold=[False, True], bordered=[False, None]), lambda: fc.use_of_color(), "CASE WHEN underlined IS TRUE OR bold THEN 'pass' WHEN link_color = '#0000ff' OR (link_color = '#000000' AND text_color = '#101010') THEN 'fail' ELSE 'pass' END")
check("chk_status_flags", R(dynamic=BN, live_region=BN), lambda: fc.status_messages(), "CASE WHEN dynamic AND live_region IS NOT TRUE THEN 'fail' WHEN dynamic THEN 'incomplete' WHEN live_region THEN 'pass' ELSE 'incomplete' END")
check("chk_accessible_auth", R(is_auth=BN, passkey=[False, True], captcha=B, captcha_alternative=BN, paste_blocked=BN, cognitive_test=[False, True]), lambda: F.array_join(fc.accessible_auth(), ","),
      "CASE WHEN is_auth IS NOT TRUE OR passkey THEN '' ELSE concat_ws(',', CASE WHEN captcha AND captcha_alternative IS NOT TRUE THEN 'captcha' END, CASE WHEN paste_blocked THEN 'paste' END, CASE WHEN cognitive_test THEN 'cognitive' END) END")
check("chk_key_flags", R(accesskey=[None, "s", "", "Enter"], handler=["if (event.key === 'k') go()", "if (event.key === 'k' && event.ctrlKey) go()", None, "go()"]), lambda: fc.char_keys(), "CASE WHEN accesskey = 's' OR (handler LIKE '%event.key%' AND handler NOT LIKE '%ctrlKey%') THEN 'incomplete' ELSE 'pass' END")
check("chk_pointer_flags", R(attrs=['onmousedown="submit()"', 'onpointerdown="open()" onpointerup="x()"', 'ontouchstart="hover()"', 'onclick="submit()"', None]), lambda: fc.pointer_cancel(), "CASE WHEN k % 5 = 0 THEN 'incomplete' ELSE 'pass' END")
check("chk_drag_flags", R(attrs=['draggable="true"', 'ondragstart="x()"', 'class="y"', None, "data-sortable"], alternative=BN), lambda: fc.dragging(), "CASE WHEN k % 5 IN (0, 1, 4) AND alternative IS NOT TRUE THEN 'incomplete' ELSE 'pass' END")
_FOC = R(f_outline=["none", "solid"], f_outline_px=[0.0, 1.0, 2.0], f_shadow=["none", "x"], u_shadow=["none", "x"], f_border=["a", "b"], u_border=["a"], f_background=["w", None], u_background=["w"], ratio=[2.9, 3.0, None])
check("chk_focus_visible", _FOC, lambda: fc.focus_change(), "CASE WHEN (f_outline <> 'none' AND f_outline_px > 0) OR f_shadow <> u_shadow OR f_border <> u_border THEN 'pass' ELSE 'fail' END")
check("chk_focus_appearance", _FOC, lambda: F.array_join(fc.focus_indicator(), ","), "CASE WHEN NOT ((f_outline <> 'none' AND f_outline_px > 0) OR f_shadow <> u_shadow) THEN 'no_indicator' ELSE concat_ws(',', CASE WHEN f_outline <> 'none' AND f_outline_px > 0 AND f_outline_px < 2 THEN 'thin' END, CASE WHEN ratio < 3 THEN 'low_contrast' END) END")
check("chk_audio_transcript", R(track=BN, links=["Get the Transcript", None, "x"], figcaption=[None, "c"], details=[False, True], described=[None, "y" * 51]), lambda: fc.audio_transcript(), "CASE WHEN track IS TRUE OR links LIKE '%Transcript%' OR figcaption IS NOT NULL OR details OR described IS NOT NULL THEN 'pass' ELSE 'incomplete' END")


@query("chk_sequence_positions", "SELECT o_orderkey AS k, CASE WHEN a <= b AND b <= c THEN 'pass' ELSE 'incomplete' END AS status FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 5 AS b, o_orderkey % 7 AS c FROM orders)")
def chk_sequence_positions(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), fc.meaningful_sequence(F.array(k % 3, k % 5, k % 7)).alias("status"))


_MOVES = "m AS (SELECT o_orderkey // 6 AS page, o_orderkey % 6 AS step, '/a?x=' || (o_orderkey % 4) AS b, CASE WHEN o_custkey % 5 = 0 THEN '/b' ELSE '/a?x=' || (o_orderkey % 4) END AS a FROM orders)"
for _n in ("chk_on_focus", "chk_on_input"):

    @query(_n, f"WITH {_MOVES} SELECT page, min(step) AS step FROM m WHERE a <> b GROUP BY page")
    def _move(spark, sf_dir):
        k = F.col("o_orderkey")
        before = F.concat(F.lit("http://h.example/a?x="), (k % 4).cast("string"))
        after = F.when(F.col("o_custkey") % 5 == 0, "http://h.example/b#top").otherwise(F.concat(before, F.lit("#top")))
        steps = table(spark, sf_dir, "orders").select(F.floor(k / 6).alias("page"), (k % 6).alias("step"), fc.moved_away(before, after).alias("moved"))
        return fc.first_move(steps)


_FIELD = "f AS (SELECT o_orderkey // 5 AS page, o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'email' ELSE 'tel' END AS key, o_orderkey % 2 AS form, CASE o_custkey % 2 WHEN 0 THEN 'checkout' ELSE 'account' END AS process, o_custkey % 4 <> 0 AS required, CASE o_custkey % 5 WHEN 0 THEN 'your email' WHEN 1 THEN 'email address' WHEN 2 THEN 'phone' WHEN 3 THEN 'your email address' ELSE 'phone' END AS words, o_custkey % 17 = 0 AS prefilled FROM orders)"


@query("chk_redundant_entry", f"""WITH {_FIELD}, t AS (SELECT *, string_split(words, ' ') AS w FROM f),
p AS (SELECT a.page, a.key, len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) AS sim, a.process = b.process AS one FROM t a JOIN t b ON a.page = b.page AND a.key = b.key AND a.id < b.id AND a.form <> b.form),
k AS (SELECT page, key, CASE WHEN sim = 1 OR (one AND sim >= 0.45) OR sim >= 0.6 THEN 'same' WHEN NOT one AND sim < 0.25 THEN 'distinct' ELSE 'unclear' END AS kind, sim FROM p),
g AS (SELECT page, key, count(*) FILTER (kind = 'same') AS same, count(*) FILTER (kind = 'unclear') AS unclear, round(CAST(max(sim) AS DOUBLE), 4) AS best FROM k GROUP BY ALL),
n AS (SELECT page, key, count(*) FILTER (required) AS required, bool_or(prefilled) AS eased FROM f GROUP BY ALL)
SELECT g.page, g.key, best, CASE WHEN eased THEN 'pass' WHEN same > 0 OR best >= 0.5 THEN 'fail' WHEN unclear > 0 THEN 'incomplete' ELSE 'pass' END AS status FROM g JOIN n ON n.page = g.page AND n.key = g.key WHERE n.required >= 2""")
def chk_redundant_entry(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = fc.cases((c % 5 == 0, "your email"), (c % 5 == 1, "email address"), (c % 5 == 3, "your email address"), default="phone")
    f = table(spark, sf_dir, "orders").select(F.floor(k / 5).alias("page"), k.alias("id"), F.when(c % 3 == 0, "email").otherwise("tel").alias("key"), (k % 2).alias("form"), F.when(c % 2 == 0, "checkout").otherwise("account").alias("process"), (c % 4 != 0).alias("required"), words.alias("words"), (c % 17 == 0).alias("prefilled"))
    return fc.redundant_entry(f)


_TAGS = R(tags=["wcag2a,wcag111,cat.x", "wcag1412,best-practice", "best-practice", "cat.y", "wcag2aa"], rule=["region", "image-alt", None])


@query("prj_sc_from_tags", f"WITH r AS ({_TAGS.cte()}) SELECT k, CASE tags WHEN 'wcag2a,wcag111,cat.x' THEN '1.1.1' WHEN 'wcag1412,best-practice' THEN '1.4.12' ELSE CASE WHEN rule = 'region' THEN '1.3.1' WHEN tags = 'best-practice' THEN 'best-practice' END END AS sc FROM r")
def prj_sc_from_tags(spark, sf_dir):
    return _TAGS.frame(spark, sf_dir).select("k", fc.criterion_of(F.split("tags", ","), F.col("rule"), {"region": "1.3.1"}).alias("sc"))


@query("flt_axe_tags", f"WITH r AS ({_TAGS.cte()}) SELECT k FROM r WHERE tags NOT IN ('cat.y')")
def flt_axe_tags(spark, sf_dir):
    asked = F.array(*[F.lit(t) for t in ("wcag2a", "wcag2aa", "best-practice")])
    return _TAGS.frame(spark, sf_dir).filter(F.arrays_overlap(F.split("tags", ","), asked)).select("k")


_QUOTE = R(reason=["See <img src='a'> and <IMG src='a'> and <img src='a'>.", "none", None, "<a id=x><b><i><u>"], element=[None, "<p>own</p>"], elements=[None, "<td>1|<td>2"])


@query("prj_infer_elements", f"WITH r AS ({_QUOTE.cte()}) SELECT k, array_to_string(list_distinct(regexp_extract_all(coalesce(reason, ''), '<[a-zA-Z][\\w:-]*[^>]*>'))[1:0], '') || CASE k % 4 WHEN 0 THEN '<img src=''a''>,<IMG src=''a''>' WHEN 3 THEN '<a id=x>,<b>,<i>' ELSE '' END AS found FROM r")
def prj_infer_elements(spark, sf_dir):
    return _QUOTE.frame(spark, sf_dir).select("k", F.array_join(fc.elements_of(F.col("reason")), ",").alias("found"))


@query("prj_custom_flat", f"WITH r AS ({_QUOTE.cte()}) SELECT k, unnest(CASE WHEN elements IS NOT NULL THEN ['<td>1', '<td>2'] WHEN element IS NOT NULL THEN [element] WHEN k % 4 = 0 THEN ['<img src=''a''>', '<IMG src=''a''>'] WHEN k % 4 = 3 THEN ['<a id=x>', '<b>', '<i>'] ELSE ['<html>'] END) AS html FROM r")
def prj_custom_flat(spark, sf_dir):
    return fc.flat_custom(_QUOTE.frame(spark, sf_dir).withColumn("elements", F.split("elements", r"\|"))).select("k", "html")


@query("conv_axe_grouped", "SELECT o_custkey AS rule, CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'incomplete' END AS status FROM orders GROUP BY o_custkey")
def conv_axe_grouped(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "pass").otherwise("incomplete")
    return fc.scanner_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rule"), status.alias("status")))


_OCR = "i AS (SELECT o_orderkey // 150 AS page, o_orderkey AS id, list_extract(['functional', 'informative', 'decorative', 'complex'], CAST(o_custkey % 4 + 1 AS BIGINT)) AS classification, o_custkey % 4 = 2 AS deco, o_custkey % 11 = 0 AS logo, o_custkey % 13 = 0 AS button, o_custkey % 7 = 0 AS txt, 's' || (o_custkey % 9) AS src FROM orders)"


@query("topk_ocr_budget", f"""WITH {_OCR}, o AS (SELECT *, row_number() OVER (PARTITION BY page, CASE WHEN deco OR logo THEN classification || ':' || src ELSE '#' || id END ORDER BY id) AS r FROM i),
p AS (SELECT *, CASE WHEN button THEN 0 WHEN txt THEN 1 WHEN classification = 'functional' THEN 2 WHEN classification = 'informative' THEN 3 WHEN logo THEN 5 WHEN deco THEN 7 ELSE 6 END AS pr FROM o WHERE r = 1)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY pr, id) <= 60 AS selected FROM p""")
def topk_ocr_budget(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("functional", "informative", "decorative", "complex")]), (c % 4 + 1).cast("int"))
    i = table(spark, sf_dir, "orders").select(F.floor(k / 150).alias("page"), k.alias("id"), kind.alias("classification"), (c % 4 == 2).alias("is_decorative"), (c % 11 == 0).alias("is_logo"), (c % 13 == 0).alias("is_button"), (c % 7 == 0).alias("is_text"), F.concat(F.lit("s"), c % 9).alias("src"))
    return fc.ocr_budget(i)


_PATH = R(path=["/x/functional/buttons/a.png", "C:\\\\informative\\\\logos\\\\b.png", "/complex/charts/c.png", "/informative/d.png", "/decorative/e.png", "/f.png", "/Functional/Images/g.png"])


@query("prj_classify_path", f"WITH r AS ({_PATH.cte()}) SELECT k, list_extract(['button', 'logo', 'chart', 'informative', 'decorative', 'other', 'image'], CAST(k % 7 + 1 AS BIGINT)) AS class FROM r")
def prj_classify_path(spark, sf_dir):
    p = F.regexp_replace(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/+", "/")
    # Folders of stored images and the classes they hold, the first that fits.
    folders = (("functional/buttons", "button"), ("functional/icons", "icon"), ("functional/logos", "logo"), ("informative/logos", "logo"), ("functional/images", "image"), ("complex/charts", "chart"), ("informative/icons", "icon"), ("informative", "informative"), ("decorative", "decorative"))
    return _PATH.frame(spark, sf_dir).select("k", fc.cases(*[(p.contains(f"/{f}/"), c) for f, c in folders], default="other").alias("class"))


_OCRT = R(confidence=[0.59, 0.6, 0.9], words=["a", "ok", "..", "日本"], width=[10.0, 50.0], height=[10.0, 50.0])


@query("flt_ocr_text", f"WITH r AS ({_OCRT.cte()}) SELECT k FROM r WHERE confidence >= 0.6 AND words IN ('ok', '日本') AND width * height >= 500")
def flt_ocr_text(spark, sf_dir):
    return _OCRT.frame(spark, sf_dir).filter((F.col("confidence") >= 0.6) & (F.length("words") > 1) & F.col("words").rlike(r"[\p{L}\p{N}]") & (F.col("width") * F.col("height") >= 500)).select("k")


@query("fn_same_document", "SELECT page_id, regexp_replace(url, '#.*$', '') AS document FROM pages")
def fn_same_document(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(urls.part(u, 1), F.lit("://"), urls.part(u, 2), urls.path_query(u)).alias("document"))
