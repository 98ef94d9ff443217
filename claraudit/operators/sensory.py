"""1.3.3: instructions that rely on shape, size, place, colour or sound alone, in English and Japanese.

A text's language is its `lang`, else Japanese from a share of CJK_SHARE such characters on, else English; a sentence of
that share is read as Japanese whatever the text is. Everything is expressions inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claraudit.functions import text

# Sensory words by category, English, then Japanese.
CATEGORIES = {
    "color": "blue red green yellow orange purple pink black white grey gray cyan magenta brown violet indigo teal navy maroon gold silver colour color coloured colored highlighted",
    "shape": "round rounded square circular circle triangular triangle rectangular oval hexagonal diamond star star-shaped pill-shaped",
    "size": "big small large tiny huge little giant wide narrow tall short smaller larger biggest smallest",
    "position": "left right top bottom above below upper lower corner center centre middle side adjacent beside next nearby underneath beneath leftmost rightmost topmost down up under over inside outside",
    "orientation": "horizontal vertical landscape portrait clockwise counterclockwise upward downward",
    "sound": "beep chime bell tone sound audio alarm buzz ring ping notification",
    "brightness": "bright dark light dim shiny glowing faded vivid dull luminous darker lighter brighter",
    "texture": "rough smooth bumpy soft hard glossy matte textured patterned striped dotted",
}
CATEGORIES_JA = {
    "color": "赤 青 緑 黄 橙 紫 ピンク 黒 白 灰色 グレー 金 銀 茶色 水色 藍 紺 赤い 青い 緑色 黄色 黄色い 白い 黒い 色 カラー 色付き 着色 オレンジ ライトブルー",
    "shape": "丸 丸い 円 円形 四角 四角い 長方形 三角 三角形 楕円 星形 ハート形 形 形状 正方形 六角形 ひし形",
    "size": "大きい 小さい 巨大 細い 太い 長い 短い 広い 狭い 大きな 小さな サイズ 大 小 大型 小型 大きめ 小さめ",
    "position": "左 右 上 下 中央 中心 隣 横 上部 下部 左側 右側 真ん中 そば 近く 内側 外側 左上 右上 左下 右下 手前 奥 前 後ろ 端 角 隅",
    "orientation": "横向き 縦向き 水平 垂直 時計回り 反時計回り 横 縦 斜め 傾き",
    "sound": "ビープ チャイム 音 通知音 アラーム ベル 着信音 サウンド 音声 ブザー 効果音",
    "brightness": "明るい 暗い 光る 輝く 鮮やか くすんだ 明度 輝度 明るめ 暗め ぼんやり",
    "texture": "滑らか 粗い ざらざら つるつる 光沢 マット テクスチャ 縞模様 水玉 格子",
}
# Words of English instructions, names of controls, words that identify nothing.
VERBS = "click press tap select choose go refer find see use follow navigate scroll drag hover open close expand collapse toggle submit enter fill type search pick hit push check uncheck enable disable tick mark focus locate identify"
NOUNS = "button icon link item element option control widget field area section menu panel bar box container form checkbox radio radiobutton dropdown select listbox textbox textfield input tab arrow step card dialog"
CONTROLS = "button icon link checkbox radio field form menu tab section item option arrow dropdown textbox textfield input card panel dialog"
FILLER = "the and for with from that this these those you your his her its our their will can may must should some any all each every a an of to in on at by is are was were please kindly just now simply merely be been being as if when then there here shown show displayed display indicated indicate marked mark located positioned placed highlighted required optional"
STATES = "marked shown displayed indicated located positioned placed highlighted circled underlined selected checked available"
EFFECTS = "submit open close save cancel confirm continue proceed navigate take"
# Phrases of purpose, of place and of required fields.
PURPOSE = r"\bto\s+(?:continue|proceed|submit|complete|finish|save|confirm|cancel|close|open|start|return|go\s+back|move\s+on)\b(?:\s+\w+){0,2}"
PLACE = r"\b(?:on|to|at|in|under|over|below|above|beside|next to)\s+the\s+(?:left|right|top|bottom|center|centre|middle|upper|lower)\b"
REQUIRED = r"\b(?:required|optional)\s+fields?\b"
# Names of controls, words that identify nothing and instructions in Japanese. Actions that also name buttons
# are no label only with a verb's ending.
NOUNS_JA = "ボタン アイコン リンク 項目 要素 オプション コントロール ウィジェット フィールド エリア セクション メニュー パネル バー ボックス コンテナ フォーム チェックボックス ラジオボタン ドロップダウン テキストボックス 入力欄 タブ 矢印 ステップ カード ダイアログ モーダル スイッチ スライダー トグル アコーディオン セレクトボックス"
FILLER_JA = "の に は を が で て と も な い た か ら れ さ り る ます です ある いる する なる から まで より ため こと もの ところ とき ように ください して でき あり これ それ あの この その など という ており てい"
REQUESTS_JA = "してください して下さい しましょう してみてください してみて"
ACTIONS_JA = "クリック タップ"
NAMING_ACTIONS_JA = "選択 入力 検索 スクロール ドラッグ 移動 送信 確認 記入 チェック"
SIGNS_JA = r"押して|押す|開いて|開く|閉じて|閉じる|(?:有効|無効)に?(?:して|する)|必須|必要|マークされ|示され|表示され|強調され"
STRIPPED_JA = r"押して(?:ください|みて)?|(?:開いて|閉じて)(?:ください)?|(?:有効|無効)に?(?:して|する)|必須(?:項目|フィールド|入力|欄)?|必要(?:です|な(?:項目|情報|フィールド|入力)?)?|(?:マークされ|示され|表示され|強調され)た?"
ENDINGS_JA = "して する します"
QUOTED = r"""["“”‘’].+?["“”‘’]|[「『].+?[」』]"""
PUNCTUATION_JA = r"[\s。、！？・「」『』（）【】〔〕…—\-～＝＋]+"

#: Characters of Japanese writing, with its punctuation and full-width forms; the share that makes a text Japanese.
CJK, CJK_SHARE = r"[\u3000-\u9fff\uff00-\uffef]", 0.15
#: Characters a text or sentence has at least: of Japanese texts, of others.
LEAST_JA, LEAST = 2, 5
#: What of an element may instruct, in order.
SOURCES = ("text", "aria_label", "title", "placeholder", "value")


def _words(listed: str, plural: bool = False) -> str:
    """Any of the listed words, whole and in either case; in the plural as well."""
    ws = listed.split()
    if plural:
        ws += [w + "es" if w.endswith(("s", "x", "z", "ch", "sh")) else w + "s" for w in ws]
    return rf"(?iU)\b(?:{text.keyword_pattern(ws)})\b"


def _parts(listed: str) -> str:
    return f"(?:{text.keyword_pattern(listed.split())})"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _without(c: Column, patterns: list[str], by: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c


_VERB_FIRST = rf"(?iU)^\s*(?:please|kindly|to|now|just)?\s*(?:{text.keyword_pattern(VERBS.split())})\b"
_ALL = " ".join(CATEGORIES.values())
_ALL_JA = " ".join(CATEGORIES_JA.values())
_ENDED_JA = rf"{_parts(NAMING_ACTIONS_JA)}{_parts(ENDINGS_JA)}|{_parts(ACTIONS_JA)}(?:{_parts(ENDINGS_JA)}|しろ)?"


def is_japanese(c: Column) -> Column:
    n = F.length(c)
    return (n > 0) & ((n - F.length(F.regexp_replace(c, CJK, ""))) / n >= CJK_SHARE)


def sentences(c: Column, japanese: Column | None = None) -> Column:
    """Sentences of a text; what ends one stays with it. In Japanese no space has to follow."""
    c = F.coalesce(c, F.lit(""))
    ja = is_japanese(c) if japanese is None else japanese | is_japanese(c)
    parts = F.when(ja, F.split(c, r"(?<=[。！？])\s*")).otherwise(F.split(c, r"(?U)(?<=[.!?])\s+"))
    return F.filter(F.transform(parts, _strip), lambda s: s != "")


def instructs(c: Column, japanese: Column) -> Column:
    """Whether a sentence tells what to do: a verb in front, required fields, or a control with where, how or what it does."""
    english = c.rlike(_VERB_FIRST) | c.rlike("(?iU)" + REQUIRED)
    effects = EFFECTS + " " + " ".join(e + "s" for e in EFFECTS.split())
    described = c.rlike(_words(STATES)) | c.rlike("(?iU)" + PLACE) | c.rlike(_words(effects))
    english = english | (c.rlike(_words(CONTROLS, plural=True)) & described)
    signs = "|".join([_parts(REQUESTS_JA), _parts(ACTIONS_JA), _parts(NAMING_ACTIONS_JA), SIGNS_JA])
    return F.when(japanese, c.rlike(signs)).otherwise(english)


def categories(c: Column, japanese: Column) -> Column:
    """Sensory categories of a sentence; of a Japanese one those of its Japanese words first."""
    english = F.array_compact(F.array(*[F.when(c.rlike(_words(w)), F.lit(k)) for k, w in CATEGORIES.items()]))
    own = F.array_compact(F.array(*[F.when(c.rlike(_parts(w)), F.lit(k)) for k, w in CATEGORIES_JA.items()]))
    return F.when(japanese, F.array_union(own, english)).otherwise(english)


def residual(c: Column, japanese: Column) -> Column:
    """What of a sentence identifies something without the senses: a quotation, or the words left without sensory words,
    kinds of controls, verbs and filler; '' for nothing."""
    rest = _without(c, ["(?iU)" + PURPOSE, _words(_ALL), _words(NOUNS, plural=True), _VERB_FIRST], " ")
    filler = F.array(*[F.lit(w) for w in FILLER.split()])
    ws = F.filter(F.split(rest, r"(?U)\W+"), lambda w: (w != "") & ((F.length(w) > 2) | w.rlike(r"(?U)^\d+$")) & ~F.array_contains(filler, F.lower(w)))
    left = _without(c, [_parts(_ALL_JA), _parts(NOUNS_JA), _parts(FILLER_JA), f"{_parts(REQUESTS_JA)}|{_ENDED_JA}|{STRIPPED_JA}", PUNCTUATION_JA], "")
    left = F.when(left.rlike(CJK + "|[a-zA-Z]{3,}"), left).otherwise("")
    quoted = F.regexp_extract(c, QUOTED, 0)
    return F.when(quoted != "", quoted).when(japanese, left).otherwise(F.array_join(ws, " "))


def findings(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each instruction that uses sensory words, of any text an element has (SOURCES that are columns; `lang`
    where there is one): sentence, categories, residual, and FAILED if that names nothing. Null and blank texts give none."""
    known = [text_col] + [c for c in SOURCES if c in rows.columns and c not in ("text", text_col)]
    texts = F.array_distinct(F.filter(F.array(*[_strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in known]), lambda t: t != ""))
    lang = F.lower(F.substring(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit(""))), 1, 2)) if "lang" in rows.columns else F.lit("")
    s = rows.withColumn("_texts", texts)
    s = s.withColumn("_ja", F.when(lang != "", lang == "ja").otherwise(is_japanese(F.array_join(F.slice("_texts", 1, 3), " "))))
    least = F.when(F.col("_ja"), LEAST_JA).otherwise(LEAST)
    s = s.withColumn("_one", F.explode(F.filter("_texts", lambda t: F.length(t) >= least)))
    s = s.withColumn("sentence", F.explode(sentences(F.col("_one"), F.col("_ja")))).filter(F.length("sentence") >= least)
    own = F.col("_ja") | is_japanese(F.col("sentence"))
    s = s.withColumn("_own", own).filter(instructs(F.col("sentence"), F.col("_own")))
    s = s.withColumn("categories", F.array_join(categories(F.col("sentence"), F.col("_own")), ",")).filter("categories <> ''")
    s = s.withColumn("residual", residual(F.col("sentence"), F.col("_own")))
    return s.withColumn("status", F.when(F.col("residual") == "", "FAILED").otherwise("PASSED")).drop("_texts", "_ja", "_one", "_own")
