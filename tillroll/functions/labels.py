"""Label algebra as columns: clean, canonical and BIO forms, roles, output keys and span texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import schema as S


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a fixed small table, null where it lacks the key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def clean_field(field: Column) -> Column:
    """Upper case with underscores; null and blank are O."""
    value = F.trim(field)
    return F.when(field.isNull() | (value == ""), "O").when(value.isin("O", "UNKNOWN"), value).otherwise(F.translate(F.upper(value), ".-/ ", "____"))


def canonical_field(field: Column, use_alias: bool = True) -> Column:
    """The field that a name or alias stands for; unknown names stay."""
    value = clean_field(field)
    if not use_alias:
        return value
    return F.when(value.isin("O", *S.FIELDS), value).otherwise(F.coalesce(lookup(S.ALIASES, value), value))


def label_field(label: Column) -> Column:
    """The canonical field of a BIO label."""
    return canonical_field(F.regexp_replace(F.trim(label), "^[BI]-", ""))


def canonical_label(label: Column, use_alias: bool = True) -> Column:
    """The BIO label with a canonical field; a label without prefix begins a span."""
    value = F.trim(label)
    field = canonical_field(F.regexp_replace(value, "^[BI]-", ""), use_alias)
    prefix = F.when(value.startswith("I-"), "I-").otherwise("B-")
    return F.when(label.isNull() | (field == "O"), "O").otherwise(F.concat(prefix, field))


def old_label(label: Column) -> Column:
    """The label with the older name of its field."""
    field = F.regexp_replace(label, "^[BI]-", "")
    prefix = F.when(label.startswith("I-"), "I-").otherwise("B-")
    return F.when(label == "O", "O").otherwise(F.concat(prefix, F.coalesce(lookup(S.OLD_NAMES, clean_field(field)), field)))


def output_key(field: Column) -> Column:
    """The key of a field in grouped receipts; unknown names in lower case, nothing as unknown."""
    known = canonical_field(field)
    return F.when(known.isin(*S.FIELDS), F.coalesce(lookup(S.OUTPUT_KEYS, known), F.lower(known))).otherwise(F.lower(F.when(F.coalesce(field, F.lit("")) == "", "unknown").otherwise(field)))


def category_field(category: Column) -> Column:
    """The field of a dataset's category, whose parts are joined by dots."""
    value = F.regexp_replace(F.regexp_replace(F.lower(F.trim(category)), r"\s+", "_"), "[-/]", "_")
    none = F.coalesce(value, F.lit("")).isin("", "o", "unknown", "none", "null")
    return F.when(none, "O").otherwise(canonical_field(F.upper(F.replace(F.replace(value, F.lit("sub_total."), F.lit("subtotal.")), F.lit("."), F.lit("_")))))


def is_head(field: Column) -> Column:
    return field.isin(*S.HEADS)


def is_item_dependent(field: Column) -> Column:
    return field.isin(*S.ITEM_DEPENDENTS)


def is_dependent(field: Column) -> Column:
    return field.isin(*S.DEPENDENTS)


def is_candidate_dependent(field: Column) -> Column:
    return field.isin(*dict.fromkeys([*S.DEPENDENTS, *S.HARD_NEGATIVES]))


def is_hard_negative_for_items(field: Column) -> Column:
    """Fields that no item may hold: O, document, summary and payment fields."""
    return field.isin("O", *S.DOCUMENT_FIELDS, *S.SUMMARY_FIELDS, *S.PAYMENT_FIELDS)


def field_for_vocabulary(field: Column, vocabulary: list[str]) -> Column:
    """The first of canonical field, its older name and the cleaned name that a vocabulary has."""
    known = canonical_field(field)
    return F.coalesce(*[F.when(x.isin(*vocabulary), x) for x in (known, lookup(S.OLD_NAMES, known), clean_field(field))])


def span_text(field: Column, text: Column) -> Column:
    """Single spaces; none in prices."""
    value = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"\s+", " ")
    return F.when(field.isin(*S.PRICE_FIELDS), F.regexp_replace(value, r"\s+", "")).otherwise(value)


def bio_labels() -> list[str]:
    """All BIO labels in order of their ids."""
    return ["O", *[f"{p}-{f}" for f in S.FIELDS for p in "BI"]]
