"""Casts of literals as people typed them. Each gives null where the text states nothing of the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the languages of the collection, and the short English ones.
MONTHS = [
    ["january", "januar", "janvier", "gennaio", "jan"],
    ["february", "februar", "février", "fevrier", "febbraio", "feb"],
    ["march", "märz", "maerz", "mars", "marzo", "mar"],
    ["april", "avril", "aprile", "apr"],
    ["may", "mai", "maggio"],
    ["june", "juni", "juin", "giugno", "jun"],
    ["july", "juli", "juillet", "luglio", "jul"],
    ["august", "août", "aout", "agosto", "aug"],
    ["september", "septembre", "settembre", "sept", "sep"],
    ["october", "oktober", "octobre", "ottobre", "oct", "okt"],
    ["november", "novembre", "nov"],
    ["december", "dezember", "décembre", "decembre", "dicembre", "dec", "dez"],
]
TRUE = ["true", "1", "y", "yes", "ja", "j", "oui", "o", "si", "sì", "vero", "wahr", "vrai"]
FALSE = ["false", "0", "n", "no", "nein", "non", "falso", "falsch", "faux"]
PLACEHOLDERS = ["", "-", "?", "n/a", "na", "s.d.", "tbd", "unknown", "inconnu", "unbekannt", "sconosciuto", "undated", "not recorded", "null", "none"]
#: white space that people and programs put around and into values
BLANKS = r"[\s    ﻿]"


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once per row and keeps the generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def text_value(t: Column) -> Column:
    return F.when(~F.lower(t).isin(PLACEHOLDERS), t)


def int_value(t: Column) -> Column:
    """Plain digits: no plus sign, leading zeros or empty fraction."""
    form = r"^([+-]?)0*(\d+)(?:[.,]0+)?$"
    digits = F.regexp_extract(t, form, 2)
    minus = F.when((F.regexp_extract(t, form, 1) == "-") & (digits != "0"), "-").otherwise("")
    return F.when(t.rlike(form), F.concat(minus, digits))


def measure_value(t: Column, units: dict[str, int], bare_unit: Column) -> Column:
    """A whole number of the base unit from a number with a point or comma and a unit; `units`: base units in one of each."""
    form = r"(?i)^\+?(\d+(?:[.,]\d+)?)\s*(" + "|".join(sorted(units, key=len, reverse=True)) + r")?$"
    number = F.translate(F.regexp_extract(t, form, 1), ",", ".").try_cast("decimal(28,9)")
    unit = F.coalesce(F.nullif(F.lower(F.regexp_extract(t, form, 2)), F.lit("")), F.lower(bare_unit))
    factor = F.coalesce(*(F.when(unit == u, F.lit(f)) for u, f in units.items()))
    return F.when(t.rlike(form), F.round(number * factor, 0).cast("decimal(28,0)").cast("string"))


def decimal2_value(t: Column) -> Column:
    """An amount with a point and exactly two decimals; grouping signs and the currency are dropped."""
    form = r"^(?:[A-Za-z]{3}|[€$£])?\s*([+-]?)(\d(?:[\d.,'’\s\u00a0\u202f]*\d)?)[.,](\d\d)\s*(?:[A-Za-z]{3}|[€$£])?$"
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, form, 2), r"\D", ""), r"^0+(?=\d)", "")
    minus = F.when(F.regexp_extract(t, form, 1) == "-", "-").otherwise("")
    return F.when(t.rlike(form), F.concat(minus, whole, F.lit("."), F.regexp_extract(t, form, 3)))


def date_value(t: Column) -> Column:
    """yyyy-mm-dd of a real date. Of two numbers before a year at the end the first is the day."""
    names = F.create_map(*(F.lit(x) for n, forms in enumerate(MONTHS, 1) for form in forms for x in (form, f"{n:02d}")))
    day = F.regexp_replace(F.lower(t), r"[t ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?$", "")
    parts = F.split(F.regexp_replace(day, r"(?<=\d)(?:er|st|nd|rd|th)\b", ""), r"(?:[-/]|[., ]+)")

    def month(word):
        return F.coalesce(F.try_element_at(names, word), F.when(word.rlike(r"^\d{1,2}$"), F.lpad(word, 2, "0")))

    def found(p):
        a, b, c = p[0], p[1], p[2]
        number, year = r"^\d{1,2}$", r"^\d{4}$"
        iso = (
            F.when(a.rlike(year) & c.rlike(number), F.concat_ws("-", a, month(b), F.lpad(c, 2, "0")))
            .when(c.rlike(year) & a.rlike(number), F.concat_ws("-", c, month(b), F.lpad(a, 2, "0")))
            .when(c.rlike(year) & b.rlike(number), F.concat_ws("-", c, F.try_element_at(names, a), F.lpad(b, 2, "0")))
        )
        return F.when(F.size(p) == 3, iso)

    return let(let(parts, found), lambda iso: F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull(), iso))


def bool_value(t: Column) -> Column:
    return F.when(F.lower(t).isin(TRUE), "true").when(F.lower(t).isin(FALSE), "false")


def typed_text(text: Column, col_type: Column, bare_unit: Column) -> Column:
    """The value of `text` as text by its column's type: text, int, int_mm, int_g, decimal2, date or bool."""

    def cast(t):
        return (
            F.when(col_type == "text", text_value(t))
            .when(col_type == "int", int_value(t))
            .when(col_type == "int_mm", measure_value(t, {"mm": 1, "cm": 10, "dm": 100, "m": 1000}, F.coalesce(bare_unit, F.lit("mm"))))
            .when(col_type == "int_g", measure_value(t, {"g": 1, "kg": 1000}, F.coalesce(bare_unit, F.lit("g"))))
            .when(col_type == "decimal2", decimal2_value(t))
            .when(col_type == "date", date_value(t))
            .when(col_type == "bool", bool_value(t))
        )

    return let(trimmed(text), cast)
