"""Dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowfeat.functions.text import fold

# French month names and abbreviations, without accents.
MONTHS = {
    1: ["janvier", "janv", "jan"],
    2: ["fevrier", "fevr", "fev"],
    3: ["mars", "mar"],
    4: ["avril", "avr"],
    5: ["mai"],
    6: ["juin"],
    7: ["juillet", "juil"],
    8: ["aout", "aou"],
    9: ["septembre", "sept", "sep"],
    10: ["octobre", "oct"],
    11: ["novembre", "nov"],
    12: ["decembre", "dec"],
}


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date_multi(c: Column, current_year: int) -> Column:
    """H9: ISO, "3 janvier 2024", d/m/y, d-m-y and d/m (of ``current_year``); years of two digits are 20xx; anything else is null."""
    text = F.trim(F.regexp_replace(fold(c), r"[\s\x{00A0}]+", " "))
    # inside the lambda the folded text is computed once, not once for each form
    return F.get(F.transform(F.array(text), lambda t: _parsed(t, current_year)), F.lit(0))


def _parsed(t: Column, current_year: int) -> Column:
    n = lambda rx, g: F.nullif(F.regexp_extract(t, rx, g), F.lit("")).cast("int")
    year = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:$|[t ])"
    full = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"
    short = r"^(\d{1,2})/(\d{1,2})$"
    long = r"^(?:[a-z]+\.? )?(\d{1,2})(?:er)? ([a-z]+)\.? (\d{4}|\d{2})$"
    names = F.create_map(*[F.lit(x) for m, ws in MONTHS.items() for w in ws for x in (w, m)])
    return F.coalesce(
        _made(n(iso, 1), n(iso, 2), n(iso, 3)),
        _made(year(n(full, 3)), n(full, 2), n(full, 1)),
        _made(F.when(t.rlike(short), F.lit(current_year)), n(short, 2), n(short, 1)),
        _made(year(n(long, 3)), F.element_at(names, F.regexp_extract(t, long, 2)), n(long, 1)),
    )
