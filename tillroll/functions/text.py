"""Text columns: OCR comparison measures, money and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that recognisers confuse; fixed values.
CONFUSIONS = [("O", "0"), ("I", "1"), ("l", "1"), ("S", "5"), ("B", "8"), ("G", "6"), (".", ",")]


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def corrected_number(text: Column) -> Column:
    return F.translate(text, "OIlSBG", "011586")


def is_numeric_token(text: Column) -> Column:
    """Has a digit, and nothing but what numbers, amounts and masked numbers have."""
    return text.rlike("[0-9]") & text.rlike(r"^[0-9.,+\-$€£¥₩%*#/:() ]+$")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def number_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.,+\-]", "")


def count_of(text: Column, characters: str) -> Column:
    """How often any of these characters occurs."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def count_mismatch(a: Column, b: Column, characters: str) -> Column:
    """Sum over the characters of the difference of their counts."""
    return sum((F.abs(count_of(a, c) - count_of(b, c)) for c in characters), F.lit(0))


def cer(truth: Column, found: Column) -> Column:
    """Edit distance by the length of the truth; of an empty truth 0 if nothing was found, else 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(found, truth) / F.length(truth))


def character_accuracy(truth: Column, found: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(found, truth) / F.greatest(F.length(truth), F.length(found), F.lit(1)))


def amount(text: Column) -> Column:
    """The number in a text, 0 if there is none."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def capture_date(capture_id: Column) -> Column:
    """The UTC date before the first underscore of an id, null if there is none."""
    return F.to_date(F.try_to_timestamp(F.substring_index(capture_id, "_", 1), F.lit("yyyyMMdd'T'HHmmss'Z'")))


def parent_capture(capture_id: Column) -> Column:
    """The id without what an augmented copy adds."""
    return F.regexp_replace(capture_id, "_(aug|augment|copy|variant)_.*", "")
