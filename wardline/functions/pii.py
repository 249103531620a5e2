"""Personal data found by pattern: e-mail addresses and phone numbers.

A pattern only runs over texts that hold a character every match must have, so most texts cost one
byte scan. Texts with a hit are tagged once, and the entities are read off the tags in text order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ---------------------------------------------------------------------------------
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "EMAIL", "PHONE")
REDACTION_LABELS = {
    "PERSON": "[PERSON_REDACTED]",
    "ORG": "[ORGANIZATION_REDACTED]",
    "GPE": "[LOCATION_REDACTED]",
    "EMAIL": "[EMAIL_REDACTED]",
    "PHONE": "[PHONE_REDACTED]",
}
# ---- End of fixed values --------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{0,2} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"

NAMES = "array<struct<label:string,name:string>>"  # what a recognizer finds in a text

# Unicode noncharacters, which no text interchanges: they mark where an entity starts, where its
# e-mail part ends, and where it ends
_START, _MIDDLE, _END = "\ufdd0", "\ufdd1", "\ufdd2"


def redaction_tag(label: str, friendly: bool = False) -> str:
    """``[LABEL_REDACTED]``; with ``friendly`` the spelled-out label."""
    return REDACTION_LABELS[label] if friendly else f"[{label}_REDACTED]"


def redaction_tag_column(label: Column, friendly: bool = False) -> Column:
    tag = F.concat(F.lit("["), label, F.lit("_REDACTED]"))
    if friendly:
        for name, text in REDACTION_LABELS.items():
            tag = F.when(label == name, F.lit(text)).otherwise(tag)
    return tag


def has_pii(text: Column) -> Column:
    return (text.contains("@") & text.rlike(EMAIL)) | (text.contains("-") & text.rlike(PHONE))


def _marked(text: Column) -> Column:
    safe = F.translate(text, _START + _MIDDLE + _END, "\ufdd3\ufdd4\ufdd5")
    return F.regexp_replace(safe, f"({EMAIL})|({PHONE})", f"{_START}$1{_MIDDLE}$2{_END}")


def _per_label(marked: Column, email: str, phone: str) -> Column:
    once = F.regexp_replace(marked, f"{_START}([^{_MIDDLE}]+){_MIDDLE}{_END}", email)
    return F.regexp_replace(once, f"{_START}{_MIDDLE}([^{_END}]+){_END}", phone)


def pii_entities(text: Column) -> Column:
    """``LABEL: entity`` strings in text order; an empty array without any."""
    tagged = _per_label(_marked(text), f"{_START}EMAIL: $1{_END}", f"{_START}PHONE: $1{_END}")
    found = F.regexp_extract_all(tagged, F.lit(f"{_START}([^{_END}]*){_END}"), F.lit(1))
    return F.when(has_pii(text), found).otherwise(F.array().cast("array<string>"))


def with_names(text: Column, patterns: Column, names: Column) -> Column:
    """Pattern entities and recognized names, ``LABEL: entity``, in text order.

    ``names`` is an array of structs (label, name); names that do not stand in the text are left out.
    """
    def placed(entity: Column, value: Column) -> Column:
        return F.struct(F.position(value, text).alias("at"), entity.alias("entity"))

    found = F.transform(patterns, lambda e: placed(e, F.substring(e, F.position(F.lit(": "), e) + 2, F.length(e))))
    named = F.transform(F.filter(F.coalesce(names, F.array().cast(NAMES)), lambda n: F.contains(text, n["name"])),
                        lambda n: placed(F.concat(n["label"], F.lit(": "), n["name"]), n["name"]))
    return F.transform(F.array_sort(F.concat(found, named)), lambda e: e["entity"])


def names_redacted(text: Column, names: Column, friendly: bool = False) -> Column:
    """The text with every recognized name replaced by its tag, longer names first."""
    by_length = F.array_sort(F.transform(F.coalesce(names, F.array().cast(NAMES)), lambda n: F.struct(
        (-F.length(n["name"])).alias("order"), n["name"].alias("name"), n["label"].alias("label"))))
    return F.aggregate(by_length, text, lambda t, n: F.replace(
        t, n["name"], redaction_tag_column(n["label"], friendly)))


def pii_redacted(text: Column, friendly: bool = False, found: Column | None = None) -> Column:
    """The text with every entity replaced by its tag.

    ``found`` says whether there is any; pass it where the entities are at hand already.
    """
    replaced = _per_label(_marked(text), redaction_tag("EMAIL", friendly), redaction_tag("PHONE", friendly))
    return F.when(has_pii(text) if found is None else found, replaced).otherwise(text)
