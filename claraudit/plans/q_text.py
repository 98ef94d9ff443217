"""Queries over the texts of `documents` and `conversations`, and over keys as text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claraudit.functions import color, text, urls
from claraudit.operators import sensory
from claraudit.operators import transcripts as tr
from claraudit.plans.registry import Records, Registry, table
from claraudit.plans.q_rules import _COLORS, _LUM, _RATIO

query = Registry()
QUERIES, SQL = query.queries, query.sql

_SPEAK = " + ".join(f"len(regexp_extract_all(text, '{p.replace('(?m)', '(?m)').replace('(?mi)', '(?mi)')}'))" for p in tr.SPEAKERS)


@query("rule_speakers", f"WITH s AS (SELECT doc_id, {_SPEAK} AS labels, CAST(n_chars % 7 AS BIGINT) AS segments FROM documents) SELECT doc_id, CAST(labels AS BIGINT) AS labels, CASE WHEN labels > 0 THEN 'PASSED' WHEN segments <= 3 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS status FROM s")
def rule_speakers(spark, sf_dir):
    labels = tr.speaker_labels(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", labels.cast("long").alias("labels"), (F.col("n_chars") % 7).alias("segments"))
    return d.select("doc_id", "labels", tr.speaker_status(F.col("labels"), F.col("segments")).alias("status"))


@query("rule_audio_events", f"WITH f AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[\\[【]([^\\]】]+)[\\]】]', 1), regexp_extract_all(text, '[(（]([^)）]+)[)）]', 1)) AS found FROM documents) SELECT doc_id, CASE WHEN len(found) = 0 THEN 'FAILED' WHEN len(list_filter(found, lambda d: regexp_matches(lower(d), '{'|'.join(tr.SOUNDS)}'))) > 0 THEN 'PASSED' ELSE 'NEEDS_REVIEW' END AS status FROM f")
def rule_audio_events(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tr.sound_status(F.col("text")).alias("status"))


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(w)).filter("next is not null")


_TURNS = "t AS (SELECT * FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"
_WORDS = "list_filter(regexp_split_to_array(lower(trim({0}, ' ')), '\\s+'), lambda w: w <> '')"


@query("rule_sequence", f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS a, {_WORDS.format('nxt')} AS b FROM t),
q AS (SELECT conv_id, turn, i, list_distinct(a[i * greatest(len(a) // 4, 1) + 1 : (i + 1) * greatest(len(a) // 4, 1)]) AS x, list_distinct(b[i * greatest(len(b) // 4, 1) + 1 : (i + 1) * greatest(len(b) // 4, 1)]) AS y FROM w, unnest([0, 1, 2, 3]) AS s(i)),
s AS (SELECT conv_id, turn, sum(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))), 4) END) / 4 AS score FROM q GROUP BY ALL)
SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN score >= 0.3 THEN 'PASSED' ELSE 'FAILED' END AS status FROM s""")
def rule_sequence(spark, sf_dir):
    scored = _turns(spark, sf_dir).select("conv_id", "turn", tr.sequence_score(F.col("text"), F.col("next")).alias("score"))
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"), F.when(F.col("score") >= tr.OVERLAP, "PASSED").otherwise("FAILED").alias("status"))


# a row of the table of distances at a time: what comes from the left is a running minimum
@query("rule_wer", f"""WITH RECURSIVE {_TURNS}, w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(nxt), '\\s+'), lambda x: x <> '') AS b FROM t),
d(conv_id, turn, i, r) AS (
  SELECT conv_id, turn, 0, range(len(b) + 1) FROM w WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(len(b) + 1), lambda j: j + list_min(s[1 : j + 1])) FROM (
    SELECT d.conv_id, d.turn, d.i, w.b, list_transform(range(len(w.b) + 1), lambda j: CASE WHEN j = 0 THEN d.i + 1 ELSE least(d.r[j + 1] + 1, d.r[j] + CAST(w.a[d.i + 1] <> w.b[j] AS BIGINT)) - j END) AS s
    FROM d JOIN w ON d.conv_id = w.conv_id AND d.turn = w.turn WHERE d.i < len(w.a))),
e AS (SELECT w.conv_id, w.turn, d.r[-1] / len(w.a) AS wer FROM w LEFT JOIN d ON d.conv_id = w.conv_id AND d.turn = w.turn AND d.i = len(w.a))
SELECT conv_id, turn, round(wer, 4) AS wer, CASE WHEN wer <= 0.15 THEN 'PASSED' WHEN wer > 0.4 THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status FROM e""")
def rule_wer(spark, sf_dir):
    scored = _turns(spark, sf_dir).select("conv_id", "turn", tr.wer("text", "next").alias("wer"))
    return scored.select("conv_id", "turn", F.round("wer", 4).alias("wer"), tr.wer_status(F.col("wer")).alias("status"))


@query("rule_transcript_prepare", "SELECT page_id, trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' ') AS plain FROM pages")
def rule_transcript_prepare(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tr.prepare(F.col("html"), F.lit("link")).alias("plain"))


# An instruction of parts: a verb that may not lead, a sensory word, a kind of control, a label that may be missing.
_SENSE = Records("orders", "o_orderkey", verb=["Click the ", "The old ", "Please press the "], sense=["round", "bright red", "new"], noun=[" icon", " house"], label=["", " Save order", ' "x"'], behind=[".", " on the left.", " to continue. It rained."])
_SENSE_JA = Records("orders", "o_orderkey", sense=["赤い", "右の丸い", "新規"], noun=["ボタン", "アイコン"], label=["", "「確認」", "送信"], verb=["をクリックしてください。", "は昨日の話。"])


@query("rule_1_3_3", f"""WITH r AS ({_SENSE.cte()}), s AS (SELECT *, noun = ' icon' AND behind = ' on the left.' AS placed, concat_ws(',', CASE sense WHEN 'bright red' THEN 'color' WHEN 'round' THEN 'shape' END, CASE WHEN behind = ' on the left.' THEN 'position' END, CASE sense WHEN 'bright red' THEN 'brightness' END) AS categories FROM r)
SELECT k, verb || sense || noun || label || replace(behind, ' It rained.', '') AS sentence, categories, CASE WHEN label = '' AND noun = ' icon' AND sense <> 'new' AND verb <> 'The old ' THEN 'FAILED' ELSE 'PASSED' END AS status
FROM s WHERE (verb <> 'The old ' OR placed OR (noun = ' icon' AND (label = ' Save order' OR behind = ' to continue. It rained.'))) AND categories <> ''""")
def rule_1_3_3(spark, sf_dir):
    rows = _SENSE.frame(spark, sf_dir).select("k", F.concat("verb", "sense", "noun", "label", "behind").alias("text"))
    return sensory.findings(rows).select("k", "sentence", "categories", "status")


@query("rule_1_3_3_ja", f"""WITH r AS ({_SENSE_JA.cte()})
SELECT k, sense || noun || label || verb AS sentence, CASE sense WHEN '赤い' THEN 'color' ELSE 'shape,position' END AS categories, CASE WHEN label = '' THEN 'FAILED' ELSE 'PASSED' END AS status FROM r WHERE verb = 'をクリックしてください。' AND sense <> '新規'
UNION ALL SELECT k, sense || noun || label || verb, CASE sense WHEN '赤い' THEN 'color' ELSE 'shape,position' END, 'PASSED' FROM r WHERE verb <> 'をクリックしてください。' AND sense <> '新規' AND label <> ''""")
def rule_1_3_3_ja(spark, sf_dir):
    rows = _SENSE_JA.frame(spark, sf_dir).select("k", F.concat("sense", "noun", "label", "verb").alias("text"))
    return sensory.findings(rows).select("k", "sentence", "categories", "status")


_CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}]"


@query("fn_cjk_ratio", f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '{_CJK}', '', 'g'))) * 1.0 / length(text) END, 6) AS ratio FROM documents")
def fn_cjk_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.cjk_ratio(F.col("text")), 6).alias("ratio"))


@query("rule_lang_detect", f"SELECT doc_id, CASE WHEN coalesce(lang, '') <> '' THEN lang WHEN length(regexp_replace(text, '{_CJK}', '', 'g')) < length(text) * 0.85 THEN 'ja' ELSE 'en' END AS detected FROM documents")
def rule_lang_detect(spark, sf_dir):
    ratio = text.cjk_ratio(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.coalesce("lang", F.lit("")) != "", F.col("lang")).when(ratio > 0.15, "ja").otherwise("en").alias("detected"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s_-]+', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


@query("fn_tokenize", f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def fn_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("fn_jaccard", f"WITH {_TURNS}, k AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a, {_TOKENS.format('nxt')} AS b FROM t) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM k")
def fn_jaccard(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", "turn", text.tokens(F.col("text")).alias("a"), text.tokens(F.col("next")).alias("b"))
    return t.select("conv_id", "turn", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("join_pairwise_jaccard", f"WITH k AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a FROM conversations) SELECT x.conv_id, x.turn AS i, y.turn AS j, round(CASE WHEN len(list_distinct(list_concat(x.a, y.a))) = 0 THEN 1.0 ELSE len(list_intersect(x.a, y.a)) * 1.0 / len(list_distinct(list_concat(x.a, y.a))) END, 6) AS jaccard FROM k x JOIN k y ON y.conv_id = x.conv_id AND x.turn < y.turn")
def join_pairwise_jaccard(spark, sf_dir):
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("a"))
    j = k.alias("x").join(k.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") < F.col("y.turn")))
    return j.select(F.col("x.conv_id").alias("conv_id"), F.col("x.turn").alias("i"), F.col("y.turn").alias("j"), F.round(text.jaccard(F.col("x.a"), F.col("y.a")), 6).alias("jaccard"))


@query("fn_norm_alt", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS norm FROM documents")
def fn_norm_alt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_alt(F.col("text")).cast("binary")).alias("norm"))


@query("fn_html_sig", "SELECT page_id, substr(sha1(substr(lower(trim(regexp_replace(html, '\\s+', ' ', 'g'), ' ')), 1, 400)), 1, 16) AS sig FROM pages")
def fn_html_sig(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_signature(F.col("html")).alias("sig"))


_T = Records("orders", "o_orderkey", a=["Nav > A", "", None, " nav  >  a "], b=["#x", None, "nav > a"])


@query("fn_target_sig", f"WITH r AS ({_T.cte()}), n AS (SELECT k, list_filter(list_transform([a, b], lambda x: lower(trim(regexp_replace(coalesce(x, ''), ' +', ' ', 'g')))), lambda x: x <> '') AS l FROM r) SELECT k, CASE WHEN len(l) = 2 AND l[1] = l[2] THEN l[1] ELSE array_to_string(l, '||') END AS sig FROM n")
def fn_target_sig(spark, sf_dir):
    return _T.frame(spark, sf_dir).select("k", text.target_signature(F.array("a", "b")).alias("sig"))


@query("fn_word_boundary_contains", "SELECT c_custkey, regexp_matches(c_mktsegment || ' ' || c_name, '\\b' || CASE c_custkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'BUILD' ELSE 'Customer' END || '\\b') AS inside FROM customer")
def fn_word_boundary_contains(spark, sf_dir):
    k = F.col("c_custkey") % 3
    part = F.when(k == 0, "BUILDING").when(k == 1, "BUILD").otherwise("Customer")
    return table(spark, sf_dir, "customer").select("c_custkey", text.word_contains(F.concat_ws(" ", "c_mktsegment", "c_name"), part).alias("inside"))


@query("prj_warn_msg", "SELECT doc_id, CASE WHEN length(text) > 320 THEN substr(text, 1, 317) || '...' ELSE text END AS message FROM documents")
def prj_warn_msg(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_message(F.col("text")).alias("message"))


_REASON = Records("orders", "o_orderkey", reason=["Fix any of the following:\n  Element has no text", "Fix all of the following: x", "plain", None, "  FIX ANY of the following: y "])


@query("prj_clean_reason", f"WITH r AS ({_REASON.cte()}) SELECT k, CASE (k % 5) WHEN 0 THEN 'Element has no text' WHEN 1 THEN 'x' WHEN 2 THEN 'plain' WHEN 3 THEN NULL ELSE 'y' END AS reason FROM r".replace("\n", "'||chr(10)||'"))
def prj_clean_reason(spark, sf_dir):
    return _REASON.frame(spark, sf_dir).select("k", text.clean_reason(F.col("reason")).alias("reason"))


_LANG = Records("orders", "o_orderkey", lang=["de-DE", "d3e!", "", None, "a-very-long-language", "ja"])


@query("fn_sanitize_lang", f"WITH r AS ({_LANG.cte()}) SELECT k, CASE WHEN coalesce(regexp_replace(lang, '[^A-Za-z-]', '', 'g'), '') = '' THEN 'en' ELSE substr(regexp_replace(lang, '[^A-Za-z-]', '', 'g'), 1, 10) END AS lang FROM r")
def fn_sanitize_lang(spark, sf_dir):
    return _LANG.frame(spark, sf_dir).select("k", text.sanitize_lang(F.col("lang")).alias("lang"))


@query("prj_template", "SELECT c_custkey, 'Page ' || c_name || ' has ' || c_nationkey || ' issues' AS message FROM customer")
def prj_template(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.render_template(F.lit("Page {page} has {n} issues"), {"page": F.col("c_name"), "n": F.col("c_nationkey")}).alias("message"))


@query("fn_is_public_ip", "WITH a AS (SELECT o_orderkey AS k, o_orderkey % 256 AS x, o_custkey % 256 AS y, o_orderkey * 7 % 300 AS z FROM orders) SELECT k, z < 256 AND NOT (x IN (0, 10, 127) OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR (x = 192 AND y = 0 AND z IN (0, 2)) OR (x = 198 AND y IN (18, 19)) OR (x = 198 AND y = 51 AND z = 100) OR (x = 203 AND y = 0 AND z = 113) OR (x = 100 AND y BETWEEN 64 AND 127) OR x >= 224) AS public FROM a")
def fn_is_public_ip(spark, sf_dir):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", k % 256, F.col("o_custkey") % 256, k * 7 % 300, F.lit("1"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), urls.public_ipv4(ip).alias("public"))


@query("src_ref_id", "SELECT page_id, 'link_' || substr(sha1('link|' || url || '|main||' || substr(html, 1, 120) || '|' || page_id), 1, 16) AS ref FROM pages")
def src_ref_id(spark, sf_dir):
    joined = F.concat_ws("|", F.lit("link"), "url", F.lit("main"), F.lit(""), F.substring("html", 1, 120), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("link_"), F.substring(F.sha1(joined.cast("binary")), 1, 16)).alias("ref"))


@query("snk_image_url", "SELECT c_custkey, '/images?path=' || replace('/tmp/a b/' || c_name, '/', '%2F').replace(' ', '%20').replace('#', '%23') AS image_url FROM customer")
def snk_image_url(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/images?path="), F.replace(F.url_encode(F.concat(F.lit("/tmp/a b/"), "c_name")), F.lit("+"), F.lit("%20"))).alias("image_url"))


@query("fn_parse_rgb", f"WITH r AS ({_COLORS.cte()}), {_LUM} SELECT k, round(x.l, 9) AS luminance FROM r JOIN lum x ON x.c = r.fg")
def fn_parse_rgb(spark, sf_dir):
    return _COLORS.frame(spark, sf_dir).select("k", F.round(color.luminance(color.parse_rgb(F.col("fg"))), 9).alias("luminance"))


_GREY = "WITH g AS (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) / 255 AS a, CAST(p_partkey * 7 % 256 AS DOUBLE) / 255 AS b FROM part), l AS (SELECT p_partkey, CASE WHEN a <= {0} THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END AS x, CASE WHEN b <= {0} THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS y FROM g)"


def _greys(spark, sf_dir):
    k = F.col("p_partkey")
    grey = lambda c: F.array(*[c.cast("int")] * 3)
    return table(spark, sf_dir, "part").select("p_partkey", grey(k % 256).alias("a"), grey(k * 7 % 256).alias("b"))


@query("fn_luminance", _GREY.format(0.03928) + " SELECT p_partkey, round(x, 9) AS luminance FROM l")
def fn_luminance(spark, sf_dir):
    return _greys(spark, sf_dir).select("p_partkey", F.round(color.luminance(F.col("a"), 0.03928), 9).alias("luminance"))


@query("fn_contrast", _GREY.format(0.04045) + " SELECT p_partkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 2) AS ratio FROM l")
def fn_contrast(spark, sf_dir):
    return _greys(spark, sf_dir).select("p_partkey", color.contrast(F.col("a"), F.col("b")).alias("ratio"))


@query("fn_large_text", f"WITH r AS ({_COLORS.cte()}) SELECT k, coalesce(font_px >= 24 OR (font_weight = 'bold' AND font_px >= 18.66), false) AS large, coalesce(font_px >= 24 OR (font_weight = 'bold' AND font_px >= 18.5), false) AS large_ocr FROM r")
def fn_large_text(spark, sf_dir):
    px, wt = F.col("font_px"), F.col("font_weight")
    return _COLORS.frame(spark, sf_dir).select("k", color.large_text(px, wt).alias("large"), color.large_text(px, wt, 18.5).alias("large_ocr"))


@query("fn_compliance", f"WITH r AS ({_COLORS.cte()}), {_LUM}, c AS (SELECT k, {_RATIO} AS ratio, coalesce(font_px >= 24, false) AS lg FROM r JOIN lum x ON x.c = r.fg JOIN lum y ON y.c = r.bg) SELECT k, ratio >= CASE WHEN lg THEN 3.0 ELSE 4.5 END AS aa, ratio >= CASE WHEN lg THEN 4.5 ELSE 7.0 END AS aaa FROM c")
def fn_compliance(spark, sf_dir):
    ratio = color.contrast(color.parse_rgb(F.col("fg")), color.parse_rgb(F.col("bg")))
    c = _COLORS.frame(spark, sf_dir).select("k", color.compliance(ratio, F.coalesce(F.col("font_px") >= 24, F.lit(False))).alias("c"))
    return c.select("k", F.col("c.aa").alias("aa"), F.col("c.aaa").alias("aaa"))
