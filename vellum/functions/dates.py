"""Dates as printed and as in the machine-readable zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in turn once separators are spaces, with four-digit years.
FORMATS = ("d MMM yyyy", "d MMMM yyyy", "d M yyyy", "yyyy M d")


def parse_date(raw: Column) -> Column:
    """A printed date, or null. Two-digit years from 69 are of the 1900s, others of the 2000s."""
    flat = F.initcap(F.trim(F.regexp_replace(raw, r"[ /.\-]+", " ")))
    short = r"^(\d{1,2}) ([A-Za-z]+|\d{1,2}) (\d{2})$"
    year = F.regexp_extract(flat, short, 3)
    century = F.when(year >= "69", "19").otherwise("20")
    full = F.when(flat.rlike(short), F.concat(F.regexp_extract(flat, short, 1), F.lit(" "), F.regexp_extract(flat, short, 2), F.lit(" "), century, year)).otherwise(flat)
    return F.coalesce(*(F.try_to_date(full, f) for f in FORMATS))


def parse_mrz_date(raw: Column, as_of: Column, is_expiry: bool) -> Column:
    """Six digits to a date of this century; a birth year after ``as_of``'s is of the century before."""
    late = (F.lit(2000) + F.substring(raw, 1, 2).try_cast("int")) > F.year(as_of)
    century = F.lit("20") if is_expiry else F.when(late, "19").otherwise("20")
    return F.when(raw.rlike(r"^[0-9]{6}$"), F.try_to_date(F.concat(century, raw), "yyyyMMdd"))
