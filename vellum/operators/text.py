"""From recognised words to lines, the machine-readable zone, document type and fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.mrz import cleaned

# Words that name a passport in three languages, patterns, length bands, confidences, words of date labels.
KEYWORDS = ("PASSPORT", "PASSEPORT", "PASAPORTE")
ZONE_LINE = "^[A-Z0-9<]{25,}$"
DATE = r"\b(\d{1,2}[ /.\-][A-Z]{3}[ /.\-]\d{2,4}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})\b"
NUMBER = r"\b([A-Z]{1,2}[0-9]{6,8}|[0-9]{7,9})\b"
NUMBER_LABEL = r"PASSPORT|\bNO\b|\bNUMBER\b"
COUNTRY = r"\b([A-Z]{3})\b"
NAME = r"[:\-]?\s*([A-Z][A-Z ]{2,})$"
SHORTEST, LONGEST = 38, 48
BOTH, EITHER, NEITHER = 0.98, 0.85, 0.40
FROM_ZONE = 0.90
DATE_LABELS = {"date_of_birth": ("birth", "dob"), "issue_date": ("issue", "issued"), "expiry_date": ("expiry", "expiration", "expire", "valid until")}
BELOW, ASIDE = 3, 0.25
FIELDS = ("document_number", "nationality", "name", *DATE_LABELS)

BOX = ("x1", "y1", "x2", "y2")


def recognised_words(raw: DataFrame) -> DataFrame:
    """What an OCR engine gives, (doc_id, seq, block, par, line, text, conf 0 to 100, x, y, w, h), as words: blank texts and those without a
    confidence are dropped, confidences are 0 to 1, boxes have corners, and lines are numbered from 0 as they are first seen."""
    rows = raw.where((F.trim("text") != "") & (F.col("conf") >= 0))
    first = rows.groupBy("doc_id", "block", "par", "line").agg(F.min("seq").alias("first"))
    numbered = first.withColumn("line_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).drop("first")
    confidence = F.least(F.greatest(F.col("conf") / 100, F.lit(0.0)), F.lit(1.0))
    return rows.join(numbered, ["doc_id", "block", "par", "line"]).select(
        "doc_id", "line_id", F.col("seq").alias("word_pos"), F.trim("text").alias("text"), confidence.alias("confidence"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"),
    )


def lines(words: DataFrame) -> DataFrame:
    """Words of a line in order of x, with their mean confidence and common box; lines numbered from the top. Words are
    gathered per line, which is short; the texts of a document never are."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_pos", "text"))), lambda w: w["text"]), " ")
    made = words.groupBy("doc_id", "line_id").agg(text.alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    order = Window.partitionBy("doc_id").orderBy("y1", "line_id")
    return made.withColumn("line_pos", F.row_number().over(order) - 1).select("doc_id", "line_pos", "text", "confidence", *BOX)


def page_lines(pages: DataFrame) -> DataFrame:
    """The same of pages that are whole in their row, (doc_id, lines) with lines of (line_id, words): a page's words are put together where
    they are, and none is shuffled. ``doc_id`` is the pages' key."""
    of = lambda l, c: F.transform(l["words"], lambda w: w[c])
    mean = lambda l: F.aggregate(of(l, "confidence"), F.lit(0.0), lambda s, x: s + x) / F.size(l["words"])
    put = lambda l: F.struct(
        F.array_min(of(l, "y1")).alias("y1"), l["line_id"].alias("line_id"), F.array_join(F.transform(F.array_sort(l["words"]), lambda w: w["text"]), " ").alias("text"),
        F.round(mean(l), 6).alias("confidence"), F.array_min(of(l, "x1")).alias("x1"), F.array_max(of(l, "x2")).alias("x2"), F.array_max(of(l, "y2")).alias("y2"),
    )
    made = F.array_sort(F.transform(F.filter("lines", lambda l: F.size(l["words"]) > 0), put))
    return pages.select("doc_id", F.posexplode(made).alias("line_pos", "l")).select("doc_id", "line_pos", "l.text", "l.confidence", *(f"l.{c}" for c in BOX))


def full_text(page: DataFrame) -> DataFrame:
    """The lines of each document, joined by newlines."""
    by = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "text"))).alias("l"))
    return by.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("full_text"))


def mean_confidence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Mean confidence of each document's words, rounded to 4, and their number; 0 without words."""
    parts = F.sum(F.round(F.col("confidence") * 10000).cast("long"))  # whole numbers: the same in any order
    per = words.groupBy("doc_id").agg(F.bround(parts / F.count("*") / 10000, 4).alias("confidence"), F.count("*").alias("words"))
    return docs.join(per, "doc_id", "left").select("doc_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("words", F.lit(0)).alias("words"))


def mrz_candidates(page: DataFrame) -> DataFrame:
    """Lines that look machine-readable: 25 characters or more of its alphabet, spaces dropped."""
    flat = F.regexp_replace(F.upper("text"), r"\s+", "")
    return page.select("doc_id", "line_pos", flat.alias("candidate"), *BOX).where(F.col("candidate").rlike(ZONE_LINE))


def mrz_pair(candidates: DataFrame) -> DataFrame:
    """(doc_id, line1, line2, zone_box) of each document with candidates. A single candidate of two lines' length is split in
    the middle; else the last two of a line's length count, if there are two; else the last two of any. A page has few candidates,
    which are gathered."""
    rows = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "candidate", *BOX))).alias("c"))
    only = F.get("c", F.lit(0))
    merged = (F.size("c") == 1) & F.length(only["candidate"]).between(2 * SHORTEST, 2 * LONGEST)
    half = F.floor(F.length(only["candidate"]) / 2).cast("int")
    fit = F.filter("c", lambda x: F.length(x["candidate"]).between(SHORTEST, LONGEST))
    last = lambda a: F.when(F.size(a) >= 2, F.slice(a, -2, 2)).otherwise(a)
    rows = rows.withColumn("chosen", F.when(F.size(fit) >= 2, last(fit)).otherwise(last(F.col("c"))))
    of = lambda i: F.get("chosen", F.lit(i))["candidate"]
    line1 = F.when(merged, F.substring(only["candidate"], F.lit(1), half)).otherwise(of(0))
    line2 = F.when(merged, F.substring(only["candidate"], half + 1, F.length(only["candidate"]))).otherwise(of(1))
    ends = lambda c: F.transform("chosen", lambda x: x[c])
    box = F.array(F.array_min(ends("x1")), F.array_min(ends("y1")), F.array_max(ends("x2")), F.array_max(ends("y2")))
    return rows.select("doc_id", line1.alias("line1"), line2.alias("line2"), box.alias("zone_box"))


def classified(page: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, type, confidence): always a passport; the confidence says how sure, by a keyword on the page and the type of a zone of two
    lines; a single line is no zone whose type could be read."""
    word = page.groupBy("doc_id").agg(F.bool_or(F.upper("text").rlike("|".join(KEYWORDS))).alias("w"))
    zone = zones.select("doc_id", (F.col("line2").isNotNull() & F.upper("line1").startswith("P")).alias("z"))
    both = word.join(zone, "doc_id", "left").withColumn("z", F.coalesce("z", F.lit(False)))
    return both.select("doc_id", F.lit("passport").alias("type"), F.when(F.col("w") & F.col("z"), BOTH).when(F.col("w") | F.col("z"), EITHER).otherwise(NEITHER).alias("confidence"))


def found_date(text: Column) -> Column:
    """The first date in a text as it is written, or null."""
    return F.nullif(F.regexp_extract(F.upper(text), DATE, 1), F.lit(""))


def _beside_or_below(x: Column) -> Column:
    """How far a line is from column ``label``: (kind, cost, pos, line), kind 0 to the right on its row, 1 below it, null elsewhere."""
    at = F.col("label")
    middle, own = (at["y1"] + at["y2"]) / 2, (x["y1"] + x["y2"]) / 2
    row = (middle.between(x["y1"], x["y2"]) | own.between(at["y1"], at["y2"])) & (x["x1"] >= at["x1"])
    below = (x["y1"] >= middle) & (x["y1"] - at["y2"] <= BELOW * F.greatest(at["y2"] - at["y1"], F.lit(1)))
    aside = F.greatest(x["x1"] - at["x2"], F.lit(0)).cast("double")
    far = (x["y1"] - at["y2"] + F.abs(x["x1"] - at["x1"]) * ASIDE).cast("double")
    return F.struct(F.when(row, 0).when(below, 1).alias("kind"), F.when(row, aside).otherwise(far).alias("cost"), x["line_pos"].alias("pos"), x.alias("line"))


def labelled_dates(page: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, box) of the date fields.

    For each field in turn the first unclaimed line with its label and a date; then, for fields without one, the first line with
    the label and the nearest unclaimed line with a date: to its right on its row, else below it within BELOW of its heights. Lines without a
    label or a date don't count, so the few that do are gathered for each document.
    """
    has = {f: F.lower("text").rlike("|".join(words)).alias(f) for f, words in DATE_LABELS.items()}
    rows = page.select("doc_id", "line_pos", "confidence", *BOX, found_date(F.col("text")).alias("date"), *has.values())
    rows = rows.where(reduce(Column.__or__, (F.col(f) for f in has), F.col("date").isNotNull()))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "confidence", *BOX, "date", *has))).alias("l"))
    docs = docs.withColumn("claimed", F.array().cast("array<int>"))
    free = lambda x: x["date"].isNotNull() & ~F.array_contains("claimed", x["line_pos"])
    claim = lambda c: F.when(F.col(c).isNotNull(), F.array_append("claimed", F.col(c)["line_pos"])).otherwise(F.col("claimed"))
    labelled = lambda f: lambda x: x[f]
    for f in has:
        docs = docs.withColumn(f"own_{f}", F.get(F.filter(F.filter("l", free), labelled(f)), F.lit(0)))
        docs = docs.withColumn("claimed", claim(f"own_{f}"))
    for f in has:
        docs = docs.withColumn("label", F.when(F.col(f"own_{f}").isNull(), F.get(F.filter("l", labelled(f)), F.lit(0))))
        near = F.transform(F.filter("l", lambda x: free(x) & (x["line_pos"] != F.col("label")["line_pos"])), _beside_or_below)
        docs = docs.withColumn("near", F.when(F.col("label").isNotNull(), F.array_min(F.filter(near, lambda x: x["kind"].isNotNull()))))
        docs = docs.withColumn(f"own_{f}", F.coalesce(F.col(f"own_{f}"), F.col("near")["line"]))
        docs = docs.withColumn("claimed", F.when(F.col("near").isNotNull(), claim(f"own_{f}")).otherwise(F.col("claimed")))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"own_{f}").alias("line")) for f in has))
    found = docs.select("doc_id", F.explode(F.filter(each, lambda x: x["line"].isNotNull())).alias("x"))
    return found.select("doc_id", "x.field", F.col("x.line.date").alias("value"), F.col("x.line.confidence").alias("confidence"), F.array(*(F.col(f"x.line.{c}") for c in BOX)).alias("box"))


def labelled_texts(page: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, box) of number, nationality and name: of each the first line that has its label and a value."""
    up = F.upper("text")
    extract = lambda text, pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    value = {
        "document_number": F.when(up.rlike(NUMBER_LABEL), extract(up, NUMBER)),
        "nationality": F.when(up.contains("NATIONAL"), extract(up, COUNTRY)),
        "name": F.when(up.contains("SURNAME") | F.trim(up).startswith("NAME"), extract(F.trim("text"), NAME)),
    }
    each = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in value.items()))
    rows = page.select("doc_id", "line_pos", "confidence", F.array(*BOX).alias("box"), F.explode(each).alias("x")).where("x.value is not null")
    first = rows.groupBy("doc_id", F.col("x.field").alias("field")).agg(F.min_by(F.struct("x.value", "confidence", "box"), "line_pos").alias("f"))
    return first.select("doc_id", "field", "f.*")


def fields(page: DataFrame, zones: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(doc_id, field, value, confidence, box, source) of every field found: as printed (``visual``), else from the zone (``mrz``;
    an issue date has no place there). A date that the zone leaves blank is missing. ``zones`` are pairs with the parsed columns;
    ``deal`` puts what was found of a document together, if one says how."""
    own = labelled_dates(page).unionByName(labelled_texts(page)).withColumn("source", F.lit("visual"))
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    zone = {"name": F.concat_ws(" ", value("given"), value("surname")), "document_number": F.col("mrz_number"), "nationality": F.col("mrz_nationality"), "date_of_birth": cleaned(F.col("mrz_dob")), "expiry_date": cleaned(F.col("mrz_expiry"))}
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(v, F.lit("")).alias("value")) for f, v in zone.items()))
    read = zones.select("doc_id", "zone_box", F.explode(each).alias("x")).where("x.value is not null")
    read = read.select("doc_id", "x.field", "x.value", F.lit(FROM_ZONE).alias("confidence"), F.col("zone_box").alias("box"), F.lit("mrz").alias("source"))
    first = deal(own.unionByName(read)).groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "confidence", "box", "source"), F.col("source") == "visual").alias("f"))
    return first.select("doc_id", "field", "f.*")


def documents(ids: DataFrame, found: DataFrame, zones: DataFrame) -> DataFrame:
    """One row for each of ``ids``: the fields as columns with their sources, and the zone's lines."""
    source = {"document_number": "number_source", "nationality": "nationality_source", "name": "name_source", "date_of_birth": "dob_source", "issue_date": "issue_source", "expiry_date": "expiry_source"}
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = found.groupBy("doc_id").agg(*(of(f, "value").alias(f) for f in FIELDS), *(of(f, "source").alias(s) for f, s in source.items()))
    return ids.join(wide, "doc_id", "left").join(zones.select("doc_id", "line1", "line2"), "doc_id", "left")


def regions(found: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, field, region): where each field stands, and the zone as field ``mrz``."""
    return found.select("doc_id", "field", F.col("box").alias("region")).unionByName(zones.select("doc_id", F.lit("mrz").alias("field"), F.col("zone_box").alias("region")))
