"""Secret scans with corpus-wide ownership frequency: hashes of candidate secrets are counted by distinct
repositories and owners, which parts widely copied examples from live-looking credentials of one owner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import spread_join, written

# What the kinds match. Group 1 is what stands before the value, group 2 the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{14,})"
HEX = r"()([0-9a-f]{16,})"
#: Further candidates, which count only if one owner alone has them: tokens of a vendor's prefix, or long ones, which must then
#: mix digits, capitals and small letters (``mixed_value``). No part looks beyond its own run of characters.
PREFIX = r"(?:gh[opsu]_|sk_live_|xox[abp]-|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,}"
OWNED = rf"()({PREFIX}|[A-Za-z0-9+/_=-]{{24,}})"
KINDS = ("assign", "access", "hex", "owned")
#: A value with this many owners is a widely copied example.
COPIED_OWNERS = 3
#: So is one in this many repositories, however few owners they have. A choice, not fitted to a table.
COPIED_REPOSITORIES = 10
#: Least share of different characters, by the length or the alphabet (16 for hex, else 62), whichever is less, of a value that
#: looks live.
LIVE_VARIETY = 0.4


def _pieces(text: Column, pattern: str) -> Column:
    marked = F.regexp_replace(F.translate(text, "\x01\x02\x04", "\x03\x03\x03"), pattern, "\x01$1\x04$2\x02")
    return F.split(marked, "\x01")


#: Pieces of a text whose offsets are added up together: an array grows by one only within a block, and by blocks.
BLOCK = 128


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def _blocks(n: Column, size: int) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))


def _matches(pieces: str, kind: int, least: int) -> Column:
    """Array of (start, rank, end, value) of all non-overlapping matches from the left, values of ``least`` characters.

    Matches are marked in the text, which is then cut at the marks, and lengths add up to offsets, block by block: the work grows
    with the matches, and with the square of their blocks alone. Texts that have the marks themselves have them replaced by another
    control, which no pattern matches either.
    """

    def cut(piece: Column) -> Column:
        lead, value = F.substring_index(piece, "\x04", 1), F.substring_index(F.substring_index(piece, "\x02", 1), "\x04", -1)
        return F.struct(F.length(lead).alias("lead"), value.alias("value"), (F.length(piece) - 2).alias("size"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["lead"] + F.length(x["value"])
        hit = F.struct(acc["at"].alias("start"), F.lit(kind).alias("rank"), end.alias("end"), x["value"].alias("value"))
        found = F.when(F.length(x["value"]) >= least, F.array_append(acc["found"], hit)).otherwise(acc["found"])
        return F.struct((acc["at"] + x["size"]).alias("at"), found.alias("found"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")

    def placed(cuts: Column) -> Column:
        part = lambda b: F.slice(cuts, b * BLOCK + 1, F.lit(BLOCK))
        sizes = F.transform(_blocks(F.size(cuts), BLOCK), lambda b: F.aggregate(part(b), F.lit(0), lambda n, x: n + x["size"]))
        begins = F.aggregate(sizes, F.array(F.length(F.element_at(pieces, 1))), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        own = lambda b, at: F.aggregate(part(b), F.struct(at.alias("at"), none.alias("found")), add, lambda acc: acc["found"])
        return _once(begins, lambda at: F.flatten(F.transform(_blocks(F.size(cuts), BLOCK), lambda b: own(b, at[b]))))

    cuts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), cut)
    return F.when(F.size(pieces) > 1, _once(cuts, placed)).otherwise(none)


def _free(more: Column, base: Column, blocks: tuple[int, ...] = (16_384, 128)) -> Column:
    """Spans of ``more`` that overlap none of ``base``. Those of a block (``more`` is in order) meet only the base spans that reach
    into its range, so that the work grows with the overlaps and not with the product."""
    meets = lambda m, b: (m["start"] < b["end"]) & (b["start"] < m["end"])
    if not blocks:
        return F.filter(more, lambda m: ~F.exists(base, lambda b: meets(m, b)))

    def block(part: Column) -> Column:
        first, last = part[0]["start"], F.element_at(part, -1)["end"]
        near = F.filter(base, lambda b: (b["end"] > first) & (b["start"] < last))
        return _once(near, lambda near: _free(part, near, blocks[1:]))

    each = F.transform(_blocks(F.size(more), blocks[0]), lambda b: _once(F.slice(more, b * blocks[0] + 1, F.lit(blocks[0])), block))
    return F.when((F.size(more) > 0) & (F.size(base) > 0), F.flatten(each)).otherwise(more)


def mixed_value(value: Column) -> Column:
    """Whether a value of kind ``owned`` has a vendor's prefix, or digits, capitals and small letters."""
    return value.rlike(f"^{PREFIX}$") | (value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"))


def live(value: Column) -> Column:
    """Whether the whole value is varied enough, and names itself no example."""
    alphabet = F.when(value.rlike("^[0-9A-Fa-f]+$"), 16).otherwise(62)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_VARIETY * F.least(F.length(value), alphabet)
    return varied & ~F.lower(value).rlike("example|sample|changeme|placeholder|xxxx|your")


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_live,
    n_shared and max_repositories.

    Base spans are whole matches in code points, ends exclusive, ordered by start and kind; ``spans`` adds
    further candidates (kind ``owned``) that overlap no base span, if their value has a single owner in the corpus, isn't
    copied and looks live. n_copied counts the document's spans whose value stands with ``copied_owners`` owners or more, or in
    ``copied_repositories`` repositories or more; n_shared those of several owners that aren't copied; n_live those of one
    owner that aren't copied and look live. The rest has one owner and doesn't look live. max_repositories is the largest
    number of repositories of a value of the document, 0 without one. Values are counted by hash, by distinct repository and owner;
    a repository name under two owners is two repositories.

    Needs columns doc_id, text, ``owner`` and ``repository``; others are ignored. Text null or empty: no spans. Null
    owners count as one owner, null repositories as one repository. doc_id null: scanned like others. Repeated
    rows: each is returned, and they count once. Empty table: no rows. Every value's counts are pre-aggregated,
    and a value of many documents is joined back in parts (``spread_join``), so no value gathers its documents in one place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\x00")).alias("repository"),
        *(_pieces(text, p).alias(f"p{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, OWNED))),
        F.monotonically_increasing_id().alias("row"),
    ).select("doc_id", "owner", "repository", "row", *(_matches(f"p{k}", k, least).alias(c) for k, (c, least) in enumerate({"assign": 12, "access": 1, "hex": 1, "more": 1}.items())))
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("base", base).withColumn("more", F.filter("more", lambda m: mixed_value(m["value"])))
    found = found.withColumn("more", _once(F.col("base"), lambda of: _once(F.col("more"), lambda more: _free(more, of))))
    keyed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("key"), live(s["value"]).alias("live")))

    # Without the texts this is small, and the row's number holds from here on.
    rows = written(found.select("row", "doc_id", "owner", "repository", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), keyed(F.concat("base", "more")).alias("all")), "secrets")
    single = rows.select("row", "owner", "repository", F.explode("all").alias("s")).select("row", "owner", "repository", "s")
    places = single.groupBy("s.key", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("key", "owner").agg(F.count("*").alias("repositories"))
    counts = places.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = spread_join(single.select("row", "s", F.col("s.key").alias("key")), written(counts, "counts"), "key")
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    own = (F.col("owners") == 1) & ~copied & F.col("s.live")
    taken = (F.col("s.rank") < 3) | own
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"))
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(taken, span)).alias("kept"),
        F.count_if(own & (F.col("s.rank") == 3)).alias("n_owned"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(own).alias("n_live"),
        F.count_if(~copied & (F.col("owners") > 1)).alias("n_shared"),
        F.max("repositories").alias("max_repositories"),
    )
    out = rows.drop("all", "owner", "repository").join(per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    spans = F.coalesce(_joined(F.col("kept")), F.lit(""))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), zero("n_owned"), zero("n_copied"), zero("n_live"), zero("n_shared"), zero("max_repositories"))
