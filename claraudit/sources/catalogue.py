"""The rule catalogue, its locale overlays and keyword lists.

The catalogue is a dimension of 87 criteria: bounded, so joins broadcast it. Overlays and keyword lists are files that a
user names; none is shipped.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.functions import text

# Fixed values: (criterion, level, severity or None, name).
CRITERIA = [
    ("1.1.1", "A", "critical", "Non-text Content"),
    ("1.2.1", "A", None, "Audio-only and Video-only (Prerecorded)"),
    ("1.2.2", "A", None, "Captions (Prerecorded)"),
    ("1.2.3", "A", None, "Audio Description or Media Alternative (Prerecorded)"),
    ("1.2.4", "AA", None, "Captions (Live)"),
    ("1.2.5", "AA", None, "Audio Description (Prerecorded)"),
    ("1.2.6", "AAA", None, "Sign Language (Prerecorded)"),
    ("1.2.7", "AAA", None, "Extended Audio Description (Prerecorded)"),
    ("1.2.8", "AAA", None, "Media Alternative (Prerecorded)"),
    ("1.2.9", "AAA", None, "Audio-only (Live)"),
    ("1.3.1", "A", None, "Info and Relationships"),
    ("1.3.2", "A", None, "Meaningful Sequence"),
    ("1.3.3", "A", None, "Sensory Characteristics"),
    ("1.3.4", "AA", "medium", "Orientation"),
    ("1.3.5", "AA", None, "Identify Input Purpose"),
    ("1.3.6", "AAA", None, "Identify Purpose"),
    ("1.4.1", "A", None, "Use of Color"),
    ("1.4.2", "A", None, "Audio Control"),
    ("1.4.3", "AA", "high", "Contrast (Minimum)"),
    ("1.4.4", "AA", "high", "Resize Text"),
    ("1.4.5", "AA", "medium", "Images of Text"),
    ("1.4.6", "AAA", "medium", "Contrast (Enhanced)"),
    ("1.4.7", "AAA", None, "Low or No Background Audio"),
    ("1.4.8", "AAA", None, "Visual Presentation"),
    ("1.4.9", "AAA", None, "Images of Text (No Exception)"),
    ("1.4.10", "AA", "high", "Reflow"),
    ("1.4.11", "AA", "high", "Non-text Contrast"),
    ("1.4.12", "AA", "high", "Text Spacing"),
    ("1.4.13", "AA", "medium", "Content on Hover or Focus"),
    ("2.1.1", "A", None, "Keyboard"),
    ("2.1.2", "A", None, "No Keyboard Trap"),
    ("2.1.3", "AAA", None, "Keyboard (No Exception)"),
    ("2.1.4", "A", None, "Character Key Shortcuts"),
    ("2.2.1", "A", None, "Timing Adjustable"),
    ("2.2.2", "A", "high", "Pause, Stop, Hide"),
    ("2.2.3", "AAA", None, "No Timing"),
    ("2.2.4", "AAA", None, "Interruptions"),
    ("2.2.5", "AAA", None, "Re-authenticating"),
    ("2.2.6", "AAA", None, "Timeouts"),
    ("2.3.1", "A", None, "Three Flashes or Below Threshold"),
    ("2.3.2", "AAA", None, "Three Flashes"),
    ("2.3.3", "AAA", None, "Animation from Interactions"),
    ("2.4.1", "A", None, "Bypass Blocks"),
    ("2.4.2", "A", None, "Page Titled"),
    ("2.4.3", "A", None, "Focus Order"),
    ("2.4.4", "A", None, "Link Purpose (In Context)"),
    ("2.4.5", "AA", None, "Multiple Ways"),
    ("2.4.6", "AA", None, "Headings and Labels"),
    ("2.4.7", "AA", None, "Focus Visible"),
    ("2.4.8", "AAA", None, "Location"),
    ("2.4.9", "AAA", None, "Link Purpose (Link Only)"),
    ("2.4.10", "AAA", None, "Section Headings"),
    ("2.4.11", "AA", "high", "Focus Not Obscured (Minimum)"),
    ("2.4.12", "AAA", "high", "Focus Not Obscured (Enhanced)"),
    ("2.4.13", "AA", None, "Focus Appearance"),
    ("2.5.1", "A", None, "Pointer Gestures"),
    ("2.5.2", "A", None, "Pointer Cancellation"),
    ("2.5.3", "A", "high", "Label in Name"),
    ("2.5.4", "A", None, "Motion Actuation"),
    ("2.5.5", "AAA", None, "Target Size"),
    ("2.5.6", "AAA", None, "Concurrent Input Mechanisms"),
    ("2.5.7", "AA", None, "Dragging Movements"),
    ("2.5.8", "AA", "medium", "Target Size (Minimum)"),
    ("3.1.1", "A", None, "Language of Page"),
    ("3.1.2", "AA", None, "Language of Parts"),
    ("3.1.3", "AAA", None, "Unusual Words"),
    ("3.1.4", "AAA", None, "Abbreviations"),
    ("3.1.5", "AAA", None, "Reading Level"),
    ("3.1.6", "AAA", None, "Pronunciation"),
    ("3.2.1", "A", None, "On Focus"),
    ("3.2.2", "A", None, "On Input"),
    ("3.2.3", "AA", None, "Consistent Navigation"),
    ("3.2.4", "AA", None, "Consistent Identification"),
    ("3.2.5", "AAA", None, "Change on Request"),
    ("3.2.6", "AA", None, "Consistent Help"),
    ("3.3.1", "A", "high", "Error Identification"),
    ("3.3.2", "A", "high", "Labels or Instructions"),
    ("3.3.3", "AA", None, "Error Suggestion"),
    ("3.3.4", "AA", None, "Error Prevention (Legal, Financial, Data)"),
    ("3.3.5", "AAA", None, "Help"),
    ("3.3.6", "AAA", None, "Error Prevention (All)"),
    ("3.3.7", "A", None, "Redundant Entry"),
    ("3.3.8", "AA", None, "Accessible Authentication (Minimum)"),
    ("3.3.9", "AAA", None, "Accessible Authentication (Enhanced)"),
    ("4.1.1", "A", None, "Parsing"),
    ("4.1.2", "A", "high", "Name, Role, Value"),
    ("4.1.3", "AA", None, "Status Messages"),
]


def values_sql() -> str:
    """The catalogue as rows of a VALUES list, for SQL on either side."""
    return ", ".join(f"('{c}', '{lv}', {'NULL' if s is None else repr(s)}, '{n}')" for c, lv, s, n in CRITERIA)


def catalogue(spark: SparkSession, lang: str = "en", overlay: DataFrame | None = None) -> DataFrame:
    """wcag_sc, level, severity, name; with an overlay (lang, wcag_sc, name) names of that language where it has them."""
    base = spark.sql(f"SELECT * FROM VALUES {values_sql()} AS t(wcag_sc, level, severity, name)")
    return base if overlay is None else overlay_names(base, overlay, lang)


def overlay_names(base: DataFrame, overlay: DataFrame, lang: str) -> DataFrame:
    """Left join of a sparse overlay; blank names fall back to the catalogue's."""
    own = overlay.filter(F.col("lang") == lang).select("wcag_sc", F.col("name").alias("_name"))
    return base.join(F.broadcast(own), "wcag_sc", "left").withColumn("name", F.coalesce(text.blank_to_null(F.col("_name")), F.col("name"))).drop("_name")


def read_yaml_catalogue(spark: SparkSession, path: str | Path) -> DataFrame:
    """wcag_sc, level, severity, name of a YAML file {rules: {id: {level, severity, name}}} on the driver."""
    import yaml

    rules = yaml.safe_load(Path(path).read_text())["rules"]
    rows = [(k, v.get("level"), v.get("severity"), v.get("name")) for k, v in rules.items()]
    return spark.createDataFrame(rows, "wcag_sc string, level string, severity string, name string")


def keyword_terms(config: dict, check: str, asset: str) -> list[str]:
    """The distinct terms of all languages of config[checks][check][asset], in order."""
    lists = config.get("checks", {}).get(check, {}).get(asset, {})
    return list(dict.fromkeys(t for terms in lists.values() for t in terms))
