"""Quality rules with cross-document line frequency: normalised lines are hashed, distinct documents counted per
host, lines above the limits removed, and depleted documents rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import words, written

#: A line is boilerplate on a host if more documents than this have it, and more than this share of the host's; on a host so
#: large that the share is above LINE_MOST documents, that many are enough.
LINE_DOCS, LINE_SHARE, LINE_MOST = 10, 0.02, 200
#: A document is depleted if less than this share of its words, or fewer words than this, remain.
LEFT_SHARE, LEFT_WORDS = 0.5, 10


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words in 5-word windows found twice or more, from column ``words``. Windows
    are sorted only where two are equal; the covered words are the gaps between such windows, 5 at most each. Each step is a column of its own, used more than once, so that
    it is computed once per row."""
    df = df.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size("hashed") - 5), lambda i: F.xxhash64(*(F.get("hashed", i + j) for j in range(5))))
    df = df.withColumn("windows", F.when(F.size("hashed") > 5, windows))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("ranked", F.when(twice, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    near = lambda k: F.try_element_at("ranked", k)["w"]
    again = lambda x, k: (x["w"] == near(k + 2)) | ((k > 0) & (x["w"] == near(F.greatest(k, F.lit(1)))))
    df = df.withColumn("places", F.when(F.col("ranked").isNotNull(), F.sort_array(F.transform(F.filter("ranked", again), lambda x: x["i"]))))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 5).otherwise(F.least(F.lit(5), p - acc["last"]))).alias("sum"))
    covered = F.aggregate("places", F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def line_frequency(lines: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST) -> DataFrame:
    """(doc, host, hashes: line hashes) to the (host, line) above the limits, by distinct documents. Distinct documents are
    told apart by (host, line, doc), so a line or host of a third of all rows is spread; the counts are summed before the shuffle."""
    size = lines.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    found = lines.select("doc", "host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count_distinct("doc").alias("n"))
    common = found.where(F.col("n") > line_docs)
    limit = F.least(line_share * F.col("docs"), F.lit(line_most))
    return common.join(size, common["host"].eqNullSafe(size["host"])).where(F.col("n") > limit).select(common["host"], "line")


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST, left_share: float = LEFT_SHARE, left_words: int = LEFT_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and n_common_words (words in removed lines).

    A line is compared without white space and in lower case. It is removed where it stands in more than ``line_docs``
    documents and more than ``line_share`` of the documents of its host, or ``line_most`` where that is less. kept is false if base_failed, or if
    fewer than ``left_words`` words or less than ``left_share`` of the words remain.

    Needs columns doc_id, text and ``host``; others are ignored. Text null or empty: no words, base_failed. Null
    hosts are one host. doc_id null: judged, and each such row counts as a document. Repeated rows: each is returned, and rows
    with one doc_id count as one document. Empty table: no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    own = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # The words are split once, line by line; no word goes over the end of a line.
    own = own.withColumn("line_words", F.transform("lines", words))
    own = _with_repeats(own.withColumn("words", F.flatten("line_words")))
    bare = F.transform("line_words", lambda x: F.struct(F.lower(F.array_join(x, "")).alias("k"), F.size(x).alias("n")))
    # Without the texts this is small, and the row's number holds from here on.
    rows = written(
        own.select(
            "row", "doc_id", "host", F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words", F.transform(bare, lambda x: F.struct(F.xxhash64(x["k"]).alias("a"), F.hash(x["k"]).alias("b"), x["n"].alias("n"))).alias("lines"),
        ), "lines",
    )
    key = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))
    doc = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row")).alias("doc")
    common = line_frequency(rows.select(doc, "host", F.array_distinct(F.transform("lines", key)).alias("hashes")), line_docs, line_share, line_most)
    single = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", key(F.col("x")).alias("line"), F.col("x.n").alias("n"))
    hit = single.join(common.select(F.col("host").alias("on_host"), F.col("line").alias("on_line")), F.col("host").eqNullSafe(F.col("on_host")) & (F.col("line") == F.col("on_line")))
    removed = hit.groupBy("row").agg(F.sum("n").alias("n_common_words"))
    out = rows.drop("lines", "host").join(removed, "row", "left")
    gone = F.coalesce("n_common_words", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - gone
    good = ~failed & (left >= left_words) & (left >= left_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), good.alias("kept"), gone.alias("n_common_words"))
