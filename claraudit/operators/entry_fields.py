"""What fields of raw pages ask for, for 3.3.7: the key, form, process, role and words of each, derived from its markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claraudit.operators.form_checks import process_type
from claraudit.operators.rules_static import cases, yes
from claraudit.operators.structure import nearest, with_of
from claraudit.sources import html
from claraudit.sources.html import attr

# Autocomplete tokens of personal data, modes that go before them, and words that stand for a token.
TOKENS = ("name", "honorific-prefix", "given-name", "additional-name", "family-name", "honorific-suffix", "nickname", "username", "new-password", "current-password", "organization-title", "organization", "street-address", "address-line1", "address-line2", "address-line3", "address-level1", "address-level2", "address-level3", "address-level4", "country", "country-name", "postal-code", "cc-name", "email", "tel")
MODES = ("shipping", "billing", "home", "work", "mobile", "fax", "pager")
KEYWORDS = (
    (r"\b(e-?mail|email|mail\s+address)\b|メール", "email"),
    (r"\b(phone|tel|telephone|mobile|contact\s*number|cell)\b|電話|携帯|連絡先", "tel"),
    (r"\b(first\s*name|given\s*name|forename)\b|名(?!称)", "given-name"),
    (r"\b(last\s*name|family\s*name|surname)\b|姓", "family-name"),
    (r"\b(full\s*name|customer\s*name|your\s*name|name)\b|氏名|お名前|名前", "name"),
    (r"\b(address\s*line\s*1|street\s*address|address1|address\s*1)\b|住所|番地", "address-line1"),
    (r"\b(address\s*line\s*2|address2|address\s*2|apartment|suite|unit)\b|建物|部屋", "address-line2"),
    (r"\b(city|town|locality)\b|市|区|町|村", "address-level2"),
    (r"\b(state|province|prefecture|region)\b|都道府県", "address-level1"),
    (r"\b(zip|postal|postcode|post\s*code)\b|郵便番号", "postal-code"),
    (r"\b(country)\b|国", "country"),
    (r"\b(company|organization|organisation|business)\b|会社|法人", "organization"),
)
# Words of fields that ask again on purpose, and of whose data a field asks.
CONFIRM = r"(?i)\b(confirm|re-?enter|again|verify|verification|repeat|retype)\b|確認|再入力|もう一度|再度|確認用"
ROLES = (
    (r"\b(billing|invoice)\b|請求", "billing"),
    (r"\b(shipping|delivery|recipient|consignee)\b|配送|お届け|受取", "shipping"),
    (r"\b(primary|main)\b|本人|主(連絡先|担当|住所|電話|メール)", "primary"),
    (r"\b(secondary|alternate|other)\b|副(連絡先|担当)|別(連絡先|住所|電話|メール)|代替", "secondary"),
    (r"\b(emergency)\b|緊急", "emergency"),
    (r"\b(guardian|parent)\b|保護者|親", "guardian"),
    (r"\b(applicant|candidate|employee|job)\b|申請者|応募者", "applicant"),
    (r"\b(reference|referee|guarantor)\b|紹介|保証人", "reference"),
)


def autocomplete_token(value: Column) -> Column:
    """The last part of an autocomplete value that asks for personal data; null without one."""
    parts = F.split(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\s+")
    known = F.filter(parts, lambda p: ~p.startswith("section-") & ~p.isin(*MODES) & p.isin(*TOKENS))
    return F.try_element_at(known, F.lit(-1))


def field_key(tag: Column, kind: Column, autocomplete: Column, words: Column) -> Column:
    """By autocomplete, then type, then words; null for fields that ask for nothing personal."""
    named = cases(*[(yes(words.rlike("(?i)" + p)), k) for p, k in KEYWORDS], default=F.lit(None).cast("string"))
    return F.coalesce(autocomplete_token(autocomplete), F.when((tag == "input") & kind.isin("email", "tel"), kind), named)


def entity_role(words: Column) -> Column:
    return cases(*[(yes(words.rlike("(?i)" + p)), r) for p, r in ROLES], default=F.lit(None).cast("string"))


def entry_fields(els: DataFrame) -> DataFrame:
    """page, id, key, form (position of the form around it, -1 outside of any), process, role, required, words, prefilled of
    the fields of raw pages that ask for personal data; confirmations and fields that are switched off are left out."""
    section = F.col("tag").isin("fieldset", "section", "article", "aside") | F.coalesce(attr("role").isin("group", "form"), F.lit(False))
    rows = nearest(nearest(els, F.col("tag") == "form", "_form"), section, "_section")
    own = html.forms(els).select("page_id", "pos", "type", "label_text", "required")
    rows = rows.join(own, ["page_id", "pos"])
    said = lambda *names: F.concat_ws(" ", *[attr(n) for n in names])
    scope = F.concat_ws(" ", said("id", "class", "name", "action", "aria-label"), F.substring("text", 1, 600))
    slim = els.select("page_id", "pos", scope.alias("_scope"))
    rows = with_of(rows, "_form", slim, F.col("_scope").alias("_form_words"))
    rows = with_of(rows, "_section", slim, F.col("_scope").alias("_section_words"))
    words = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", said("name", "id", "placeholder", "aria-label", "autocomplete", "title", "data-testid", "class", "inputmode"), F.col("label_text")), r"\s+", " ")))
    rows = rows.withColumn("words", words).withColumn("key", field_key(F.col("tag"), F.col("type"), attr("autocomplete"), F.col("words")))
    rows = rows.filter(F.col("key").isNotNull() & ~F.col("words").rlike(CONFIRM) & ~F.array_contains(F.map_keys("attrs"), "disabled"))
    around = F.lower(F.concat_ws(" ", "_section_words", "words"))
    need = F.col("required") | (F.lower(F.coalesce(attr("aria-required"), F.lit(""))) == "true")
    process = process_type(F.lower(F.coalesce("_form_words", F.lit(""))), around)
    role = entity_role(F.concat_ws(" ", around, F.lower("_form_words")))
    return rows.select(F.col("page_id").alias("page"), F.col("pos").cast("long").alias("id"), "key", F.coalesce("_form", F.lit(-1)).alias("form"), process.alias("process"), role.alias("role"), need.alias("required"), "words", (F.trim(F.coalesce(attr("value"), F.lit(""))) != "").alias("prefilled"))
