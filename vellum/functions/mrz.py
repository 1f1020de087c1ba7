"""Machine-readable zone: check digits and the two-line, 44-character layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cyclic weights of check digits, and the width of a line.
WEIGHTS = (7, 3, 1)
WIDTH = 44


def char_value(c: Column) -> Column:
    """Digits and letters by value; anything else counts 0 (ASCII only)."""
    code = F.ascii(c)
    return F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55).otherwise(0)


def check_digit(data: Column) -> Column:
    """Weighted sum of the character values, modulo 10, as a string."""
    weigh = lambda c, i: char_value(c) * F.element_at(F.array(*map(F.lit, WEIGHTS)), (i % 3 + 1).cast("int"))
    total = F.aggregate(F.transform(F.split(data, ""), weigh), F.lit(0), lambda a, x: a + x)
    return (total % 10).cast("string")


def cleaned(token: Column) -> Column:
    return F.trim(F.translate(token, "<", " "))


def padded(line: Column) -> Column:
    return F.rpad(F.upper(F.trim(line)), WIDTH, "<")


def parsed(line1: Column, line2: Column) -> dict[str, Column]:
    """The fields of two lines, as columns by name. Dates stay as read."""
    part = lambda line, a, n: F.substring(line, a, n)
    names = F.split(part(line1, 6, 39), "<<", 2)
    return {
        "mrz_type": part(line1, 1, 1),
        "issuer": cleaned(part(line1, 3, 3)),
        "surname": cleaned(F.element_at(names, 1)),
        "given": cleaned(F.coalesce(F.try_element_at(names, F.lit(2)), F.lit(""))),
        "mrz_number": cleaned(part(line2, 1, 9)),
        "mrz_nationality": cleaned(part(line2, 11, 3)),
        "mrz_dob": part(line2, 14, 6),
        "mrz_sex": part(line2, 21, 1),
        "mrz_expiry": part(line2, 22, 6),
        "mrz_optional": part(line2, 29, 14),
    }


def checks(line2: Column) -> dict[str, tuple[Column, Column]]:
    """Of each check: the data it covers, and the digit read."""
    part = lambda a, n: F.substring(line2, a, n)
    return {
        "NUMBER": (part(1, 9), part(10, 1)),
        "DOB": (part(14, 6), part(20, 1)),
        "EXPIRY": (part(22, 6), part(28, 1)),
        "OPTIONAL": (part(29, 14), part(43, 1)),
        "COMPOSITE": (F.concat(part(1, 10), part(14, 7), part(22, 22)), part(44, 1)),
    }


def with_mrz(docs: DataFrame) -> DataFrame:
    """Adds the parsed fields, each check's outcome (null where it is skipped), and whether the zone is reliable:
    two lines, and not all of the checks made of parts fail together."""
    docs = docs.withColumns({"padded1": padded(F.col("line1")), "padded2": padded(F.col("line2"))})
    l1, l2 = F.col("padded1"), F.col("padded2")
    two = F.col("line1").isNotNull() & F.col("line2").isNotNull()
    docs = docs.withColumns({"has_mrz": F.coalesce(F.col("line1"), F.col("line2")).isNotNull(), "two_lines": two})
    docs = docs.withColumns({k: F.when(two, v) for k, v in parsed(l1, l2).items()})
    found = {}
    for name, (data, read) in checks(l2).items():
        skipped = (read == "<") if name == "OPTIONAL" else F.lit(False)
        found[f"ok_{name.lower()}"] = F.when(two & ~skipped, check_digit(data) == read)
    docs = docs.withColumns(found)
    parts = F.filter(F.array("ok_number", "ok_dob", "ok_expiry", "ok_optional"), lambda x: x.isNotNull())
    wrecked = (F.size(parts) >= 2) & ~F.exists(parts, lambda x: x)
    return docs.withColumn("reliable", two & ~wrecked).drop("padded1", "padded2")
