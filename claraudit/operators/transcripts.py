"""Checks of transcripts against speech: word errors, speakers, sounds, order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

WER_PASS, WER_FAIL, OVERLAP = 0.15, 0.40, 0.30
# Sounds that descriptors name, in English and Japanese.
SOUNDS = ("applause", "laughter", "music", "silence", "pause", "noise", "clapping", "cheering", "alarm", "beep", "crash", "door", "phone", "inaudible", "crosstalk", "sound", "sigh", "cough", "crying", "singing", "humming", "whistling", "thunder", "rain", "wind", "footsteps", "knock", "ring", "buzz", "click", "snap", "pop", "gasp", "scream", "whisper", "mumbling", "static", "feedback")
SOUNDS_JA = ("拍手", "笑い声", "音楽", "静寂", "沈黙", "休止", "雑音", "ノイズ", "手拍子", "歓声", "アラーム", "ビープ音", "衝突音", "ドア", "電話", "聞き取り不能", "クロストーク", "音", "ため息", "咳", "泣き声", "歌", "鼻歌", "口笛", "雷", "雨", "風", "足音", "ノック", "ベル", "ブザー", "クリック", "スナップ", "破裂音", "喘ぎ", "悲鳴", "ささやき", "つぶやき", "スタティック", "フィードバック")
# How transcripts mark speakers, in English and Japanese.
SPEAKERS = (r"(?m)^[A-Z][a-zA-Z\s]{1,30}:\s", r"(?m)\[[A-Z][a-zA-Z\s]{1,30}\]", r"(?mi)^Speaker\s\d+:", r"(?mi)^Interviewer:", r"(?mi)^Host:", r"(?mi)^Narrator:", r"(?mi)^Moderator:")


SPEAKERS_JA = (r"(?m)^[^\s：]{1,10}：", r"(?m)^【[^\s】]{1,10}】", r"(?m)^話者\s?\d+：", r"(?m)^インタビュアー：", r"(?m)^ホスト：", r"(?m)^ナレーター：", r"(?m)^司会：")


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two sequences of numbers: all rows of the table at once as bits of whole numbers, a step for each
    element of b. A word's bits say where it stands in a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) >> 1
    up, down, score = full, 0, len(a)  # where the next row is one more, one less
    for x in b.tolist():
        same = places.get(x, 0)
        level = ((same & up) + up ^ up) | same
        more, less = (down | ~(level | up)) & full, up & level
        score += bool(more & last) - bool(less & last)
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & full, more & same & full
    return score


def word_errors(reference: list[str], text: list[str]) -> int:
    """Words to change, add or leave out; what both begin or end with costs nothing."""
    start = 0
    while start < min(len(reference), len(text)) and reference[start] == text[start]:
        start += 1
    end = 0
    while end < min(len(reference), len(text)) - start and reference[-1 - end] == text[-1 - end]:
        end += 1
    a, b = reference[start : len(reference) - end], text[start : len(text) - end]
    if not a or not b:
        return max(len(a), len(b))
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    return _distance(*(np.array([code[w] for w in x]) for x in (a, b)))


def units(text: str | None, lang: str) -> list[str]:
    """Lower-case words; of a Japanese text characters, as words aren't spaced."""
    words = (text or "").lower().split()
    return list("".join(words)) if lang == "ja" else words


@pandas_udf(DoubleType())
def _rate(reference: pd.Series, text: pd.Series, lang: pd.Series) -> pd.Series:
    out = []
    for r, t, x in zip(reference, text, lang, strict=True):
        a, b = units(r, x), units(t, x)
        out.append(word_errors(a, b) / len(a) if a and b else None)
    return pd.Series(out, dtype="float64")


def wer(reference: Column | str, text: Column | str, lang: Column | str = "en") -> Column:
    """Word error rate, of characters for lang 'ja' (a language's name or a column); null where either text has none."""
    return _rate(reference, text, F.lit(lang) if isinstance(lang, str) else F.coalesce(lang, F.lit("en")))


def wer_status(score: Column) -> Column:
    return F.when(score <= WER_PASS, "PASSED").when(score > WER_FAIL, "FAILED").otherwise("NEEDS_REVIEW")


def speaker_labels(text: Column, lang: str = "en") -> Column:
    """How many marks of speakers a text has, over all patterns of the language."""
    return sum((F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in (SPEAKERS_JA if lang == "ja" else SPEAKERS)), F.lit(0))


def speaker_status(labels: Column, segments: Column) -> Column:
    return F.when(labels > 0, "PASSED").when(segments <= 3, "NEEDS_REVIEW").otherwise("FAILED")


def sound_status(text: Column, lang: str = "en") -> Column:
    """No descriptor in brackets fails; one that names a known sound passes."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"[\[【]([^\]】]+)[\]】]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"[(（]([^)）]+)[)）]"), F.lit(1)))
    known = F.exists(found, lambda d: F.lower(d).rlike("|".join(SOUNDS_JA if lang == "ja" else SOUNDS)))
    return F.when(F.size(found) == 0, "FAILED").when(known, "PASSED").otherwise("NEEDS_REVIEW")


def quarters(words: Column) -> Column:
    """Four arrays of equal length; a rest behind them is left out."""
    n = F.greatest(F.floor(F.size(words) / 4), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_distinct(F.slice(words, i * n + 1, n)))


def sequence_score(a: Column, b: Column) -> Column:
    """Mean word overlap of matching quarters, each rounded to four places."""
    split = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    pairs = F.arrays_zip(quarters(split(a)).alias("x"), quarters(split(b)).alias("y"))
    scores = F.transform(pairs, lambda p: F.when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"])), 4)))
    return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / 4


def prepare(text: Column, kind: Column) -> Column:
    """Plain transcript of a page (tags off), of a caption track (headers, times and numbers off) or inline."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.rlike(r"^\d{2}:\d{2}") & ~x.rlike(r"^\d+$"))
    return F.when(kind == "link", F.trim(F.regexp_replace(text, "<[^>]+>", " "))).when(kind == "track", F.array_join(lines, " ")).otherwise(F.trim(text))
