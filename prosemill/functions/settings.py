"""Stored settings: a column of JSON texts as repaired settings, each field on its own."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.plans.options import CHARS_BOUNDS, LONG_BOUNDS, RULES, VERY_LONG_BOUNDS, Settings, stored_name


def settings_of(json: Column) -> Column:
    """The settings that a JSON text holds: a struct with the names of ``Settings``.

    A field of another type than its own is the default; numbers are rounded and clamped; of lists the strings stay. What is
    no JSON object holds nothing. Applied to what it gives, as JSON with the stored names, it changes nothing.
    """
    whole = F.try_parse_json(json)
    default = Settings()

    def at(path: str) -> tuple[Column, Column]:
        value = F.try_variant_get(whole, f"$.{path}", "variant")
        return value, F.coalesce(F.schema_of_variant(value), F.lit(""))

    def typed(path: str, kind: str, usual: bool | str) -> Column:
        value, own = at(path)
        return F.coalesce(F.when(own == kind, value.cast("boolean" if kind == "BOOLEAN" else "string")), F.lit(usual))

    def number(path: str, usual: int, bounds: tuple[int, int]) -> Column:
        value, own = at(path)
        numeric = own.isin("BIGINT", "DOUBLE", "FLOAT") | own.startswith("DECIMAL")
        rounded = F.floor(F.when(numeric, value.cast("double")) + 0.5)
        clamped = F.greatest(F.least(rounded, F.lit(bounds[1])), F.lit(bounds[0]))
        return F.when(rounded.isNull(), usual).otherwise(clamped).cast("int")

    def strings(path: str) -> Column:
        value, own = at(path)
        items = F.when(own.startswith("ARRAY"), F.try_variant_get(whole, f"$.{path}", "array<variant>"))
        texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
        return F.coalesce(texts, F.array().cast("array<string>"))

    rules = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[typed(f"rules.{r}", "BOOLEAN", default.rules[r]) for r in RULES]))
    long = number("longSentenceWords", default.long_sentence_words, LONG_BOUNDS)
    special = {
        "is_pro": typed("isPro", "BOOLEAN", False),
        "rules": rules,
        "long_sentence_words": long,
        "very_long_sentence_words": F.greatest(long + 1, number("veryLongSentenceWords", default.very_long_sentence_words, VERY_LONG_BOUNDS)),
        "max_note_chars": number("maxNoteChars", default.max_note_chars, CHARS_BOUNDS),
        "schema_version": F.lit(default.schema_version),
    }

    def column(name: str) -> Column:
        usual = getattr(default, name)
        if name in special:
            return special[name]
        if isinstance(usual, tuple):
            return strings(stored_name(name))
        return typed(stored_name(name), "BOOLEAN" if isinstance(usual, bool) else "STRING", usual)

    return F.struct(*[column(f.name).alias(f.name) for f in fields(Settings)])
