"""The catalogue of deterministic rules: one projection makes each document's findings, in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.dates import parse_date, parse_mrz_date
from vellum.functions.mrz import with_mrz

# The required fields, and the fields with dates.
REQUIRED = ("document_number", "name", "date_of_birth", "nationality", "issue_date", "expiry_date")
DATES = ("date_of_birth", "issue_date", "expiry_date")
CHECKS = {"NUMBER": "document_number", "DOB": "date_of_birth", "EXPIRY": "expiry_date", "OPTIONAL": "optional", "COMPOSITE": "composite"}


@dataclass(frozen=True)
class RuleSet:
    """What a type of document is held to: its groups of rules, in order, and the fields it must have (``mrz`` is one)."""

    groups: tuple[str, ...]
    required: tuple[str, ...]


COMMON = ("required_field", "format", "date", "mrz", "consistency")
#: The catalogue: a row a type. Types that aren't in it are held to the passport's.
CATALOGUE = {"passport": RuleSet((*COMMON, "passport"), (*REQUIRED, "mrz"))}
FALLBACK = "passport"


def catalogue_table(spark: SparkSession, catalogue: dict[str, RuleSet] = CATALOGUE) -> DataFrame:
    """The catalogue as a table (type, groups, required), as a deployment keeps it."""
    return spark.createDataFrame([(t, list(r.groups), list(r.required)) for t, r in sorted(catalogue.items())], "type string, groups array<string>, required array<string>")


def read_catalogue(table: DataFrame) -> dict[str, RuleSet]:
    """The catalogue of such a table. A group that no rules are registered for is an error, as is a table without the fallback type."""
    found = {r["type"]: RuleSet(tuple(r["groups"]), tuple(r["required"])) for r in table.collect()}  # a row a type
    unknown = {g for r in found.values() for g in r.groups} - set(GROUPS)
    if unknown or FALLBACK not in found:
        raise ValueError(f"no rules for {sorted(unknown)}" if unknown else f"no rules for type {FALLBACK}, which others fall back to")
    return found


def missing_fields(typed: DataFrame, present: DataFrame, catalogue: dict[str, RuleSet] = CATALOGUE) -> DataFrame:
    """(doc_id, type) and (doc_id, field) to the (doc_id, field) that the type requires and the document lacks. The catalogue has a row a
    type, which is broadcast."""
    need = catalogue_table(typed.sparkSession, catalogue).select("type", "required")
    default = F.array(*map(F.lit, catalogue[FALLBACK].required))
    wanted = typed.join(F.broadcast(need), "type", "left").select("doc_id", F.explode(F.coalesce("required", default)).alias("field"))
    return wanted.join(present.select("doc_id", "field"), ["doc_id", "field"], "left_anti")


def prepared(docs: DataFrame, as_of: str) -> DataFrame:
    """Adds the parsed zone, dates and normalised values that rules look at, each computed once per document."""
    docs = with_mrz(docs)
    day = F.lit(as_of).cast("date")
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    tokens = lambda c: F.filter(F.split(F.upper(c), r"\s+"), lambda t: t != "")
    visual = lambda c, source: F.when(F.col(source) == "visual", value(F.col(c)))
    usable = lambda c, source: F.col(c).isNotNull() & ((F.col(source) != "mrz") | ~F.col("has_mrz") | F.col("reliable"))
    read = lambda c, source, expiry: F.when(F.col(source) == "mrz", parse_mrz_date(F.col(c), day, expiry)).otherwise(parse_date(F.col(c)))
    ident = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return docs.withColumns(
        {
            "as_of": day,
            "dob_usable": usable("date_of_birth", "dob_source"),
            "issue_usable": usable("issue_date", "issue_source"),
            "expiry_usable": usable("expiry_date", "expiry_source"),
            "dob_date": read("date_of_birth", "dob_source", False),
            "issue_day": read("issue_date", "issue_source", False),
            "expiry_day": read("expiry_date", "expiry_source", True),
            "zone_dob": parse_mrz_date(F.col("mrz_dob"), day, False),
            "zone_expiry": parse_mrz_date(F.col("mrz_expiry"), day, True),
            "v_nationality": value(F.col("nationality")),
            "v_number": value(F.col("document_number")),
            "own_number": visual("document_number", "number_source"),
            "own_name": visual("name", "name_source"),
            "own_dob": visual("date_of_birth", "dob_source"),
            "own_expiry": visual("expiry_date", "expiry_source"),
            "own_nationality": visual("nationality", "nationality_source"),
            "name_tokens": tokens(F.col("name")),
            "zone_tokens": tokens(F.concat_ws(" ", "given", "surname")),
            "id_nationality": ident(F.col("nationality")),
            "zone_nationality": ident(F.col("mrz_nationality")),
            "id_number": ident(F.col("document_number")),
            "zone_number": ident(F.col("mrz_number")),
        }
    )


def _finding(rule: str, category: str, field: str, when: Column, status: Column, severity: Column) -> Column:
    """A finding, or null where the rule isn't emitted. Severity is INFO unless it fails or warns."""
    low = F.when(status.isin("PASS", "NOT_APPLICABLE"), "INFO").otherwise(severity)
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(field).alias("field"), status.alias("status"), low.alias("severity")))


def _ok(good: Column, bad: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise(bad)


def _dates() -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Whether each date field is usable, and its day if so."""
    uses = tuple(F.col(x) for x in ("dob_usable", "issue_usable", "expiry_usable"))
    return uses, tuple(F.when(use, F.col(day)) for use, day in zip(uses, ("dob_date", "issue_day", "expiry_day")))


GROUPS: dict[str, Callable[[RuleSet], list[Column]]] = {}


def rule_group(name: str) -> Callable:
    """Register the rules of a group: a function of a type's rule set to its findings, in order."""
    def add(f: Callable[[RuleSet], list[Column]]) -> Callable[[RuleSet], list[Column]]:
        GROUPS[name] = f
        return f

    return add


@rule_group("required_field")
def _required(held: RuleSet) -> list[Column]:
    one = lambda f: _finding(f"REQUIRED_{f.upper()}", "required_field", f, F.lit(True), _ok(F.col("has_mrz"), "WARNING") if f == "mrz" else _ok(F.trim(F.col(f)) != "", "FAIL"), F.lit("MEDIUM"))
    return [one(f) for f in held.required]


@rule_group("format")
def _formats(held: RuleSet) -> list[Column]:
    c, ok, sev = F.col, _ok, F.lit
    out = [_finding(f"FORMAT_NONEMPTY_{f.upper()}", "format", f, c(f).isNotNull() & (F.trim(c(f)) == ""), F.lit("FAIL"), sev("LOW")) for f in REQUIRED]
    out.append(_finding("FORMAT_NATIONALITY", "format", "nationality", c("v_nationality").isNotNull(), ok(F.upper("v_nationality").rlike("^[A-Z]{3}$"), "WARNING"), sev("LOW")))
    out.append(_finding("FORMAT_DOCUMENT_NUMBER_GENERIC", "format", "document_number", c("v_number").isNotNull(), ok(c("v_number").rlike(r"^[A-Za-z0-9\- ]{4,20}$"), "WARNING"), sev("LOW")))
    return out


@rule_group("date")
def _date_rules(held: RuleSet) -> list[Column]:
    c, ok, sev, out = F.col, _ok, F.lit, []
    uses, (dob, issue, expiry) = _dates()
    for field, use, day in zip(DATES, uses, (dob, issue, expiry)):
        out.append(_finding(f"DATE_VALID_{field.upper()}", "date", field, use, ok(day.isNotNull(), "FAIL"), sev("HIGH")))
    out.append(_finding("DATE_ISSUE_BEFORE_EXPIRY", "date", "issue_date", issue.isNotNull() & expiry.isNotNull(), ok(issue < expiry, "FAIL"), sev("HIGH")))
    out.append(_finding("DATE_EXPIRY_STATUS", "date", "expiry_date", expiry.isNotNull(), ok(expiry >= c("as_of"), "WARNING"), sev("LOW")))
    out.append(_finding("DATE_DOB_BEFORE_ISSUE", "date", "date_of_birth", dob.isNotNull() & issue.isNotNull(), ok(dob < issue, "FAIL"), sev("HIGH")))
    return out


@rule_group("mrz")
def _zone_rules(held: RuleSet) -> list[Column]:
    c, ok, sev, out = F.col, _ok, F.lit, []
    has, good = c("has_mrz"), c("reliable")
    out.append(_finding("MRZ_PRESENT", "mrz", "mrz", ~has, F.lit("WARNING"), sev("MEDIUM")))
    out.append(_finding("MRZ_STRUCTURE", "mrz", "mrz", has, ok(c("two_lines"), "FAIL"), sev("MEDIUM")))
    out.append(_finding("MRZ_UNRELIABLE", "mrz", "mrz", c("two_lines") & ~good, F.lit("WARNING"), sev("MEDIUM")))
    for name, field in CHECKS.items():
        hit = c(f"ok_{name.lower()}")
        out.append(_finding(f"MRZ_CHECK_{name}", "mrz", field, good & hit.isNotNull(), ok(hit, "FAIL"), sev("HIGH")))
    return out


@rule_group("consistency")
def _consistency(held: RuleSet) -> list[Column]:
    c, ok, sev, out, good = F.col, _ok, F.lit, [], F.col("reliable")
    out.append(_finding("CONSISTENCY_MRZ", "consistency", "mrz", ~good, F.lit("NOT_APPLICABLE"), sev("INFO")))
    both = lambda a, b, status: F.when(a.isNull() | b.isNull() | (b == ""), "NOT_APPLICABLE").otherwise(status)
    times = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    within = (F.size("name_tokens") > 0) & F.forall("name_tokens", lambda t: times("name_tokens", t) <= times("zone_tokens", t))
    out.append(_finding("CONSISTENCY_NAME", "consistency", "name", good, both(c("own_name"), F.concat("given", "surname"), ok(within, "FAIL")), sev("HIGH")))

    def same_day(rule: str, field: str, text: str, day: Column, zone: Column) -> Column:
        status = F.when(c(text).isNull() | zone.isNull(), "NOT_APPLICABLE").otherwise(ok(day == zone, "FAIL"))
        return _finding(f"CONSISTENCY_{rule}", "consistency", field, good, status, F.when(day.isNull(), "MEDIUM").otherwise("HIGH"))

    out.append(same_day("DOB", "date_of_birth", "own_dob", c("dob_date"), c("zone_dob")))
    same = c("id_number") == c("zone_number")
    cut = (c("id_number") != "") & (c("zone_number") != "") & (c("id_number").startswith(c("zone_number")) | c("zone_number").startswith(c("id_number")))
    number = both(c("own_number"), c("mrz_number"), F.when(same, "PASS").when(cut, "WARNING").otherwise("FAIL"))
    out.append(_finding("CONSISTENCY_DOCUMENT_NUMBER", "consistency", "document_number", good, number, F.when(cut, "LOW").otherwise("HIGH")))
    nation = both(c("own_nationality"), c("mrz_nationality"), ok(c("id_nationality") == c("zone_nationality"), "FAIL"))
    out.append(_finding("CONSISTENCY_NATIONALITY", "consistency", "nationality", good, nation, sev("MEDIUM")))
    out.append(same_day("EXPIRY", "expiry_date", "own_expiry", c("expiry_day"), c("zone_expiry")))
    return out


@rule_group("passport")
def _passport(held: RuleSet) -> list[Column]:
    c, ok, sev, out = F.col, _ok, F.lit, []
    has, good = c("has_mrz"), c("reliable")
    out.append(_finding("PASSPORT_DOC_NUMBER_FORMAT", "passport", "document_number", c("v_number").isNotNull(), ok(c("id_number").rlike("^[A-Z0-9]{1,9}$"), "WARNING"), sev("MEDIUM")))
    out.append(_finding("PASSPORT_MRZ_FORMAT", "passport", "mrz", has, ok(c("two_lines"), "WARNING"), sev("MEDIUM")))
    out.append(_finding("PASSPORT_MRZ_TYPE", "passport", "mrz", good, ok(c("mrz_type") == "P", "WARNING"), sev("MEDIUM")))
    out.append(_finding("PASSPORT_MRZ_SEX", "passport", "sex", good, ok(c("mrz_sex").isin("M", "F", "X", "<", ""), "WARNING"), sev("LOW")))
    return out


def findings(docs: DataFrame, catalogue: dict[str, RuleSet] = CATALOGUE) -> DataFrame:
    """(doc_id, pos, rule_id, category, field, status, severity) of ``prepared`` documents, in catalogue order.

    A column ``type``, if there is one, says what each document is held to; a type that isn't in the catalogue, or is null, falls back.
    Rule sets are compiled to one array of findings each, in one projection: a document makes those of its own type.
    """
    made = {t: F.filter(F.array(*(x for g in held.groups for x in GROUPS[g](held))), lambda x: x.isNotNull()) for t, held in catalogue.items()}
    out = made[FALLBACK]
    if "type" in docs.columns:
        for t in sorted(set(made) - {FALLBACK}):
            out = F.when(F.col("type") == t, made[t]).otherwise(out)
    return docs.select("doc_id", F.posexplode(out).alias("pos", "f")).select("doc_id", "pos", "f.*")


def summary(found: DataFrame) -> DataFrame:
    """Per document: total, counts by status, failures and warnings by severity (passes left out), any failure."""
    n = lambda cond: F.count_if(cond)
    status, severity = F.col("status"), F.col("severity")
    cols = [n(status == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARNING", "FAIL", "NOT_APPLICABLE")]
    cols += [n((status != "PASS") & (severity == s)).alias(f"sev_{s.lower()}") for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]
    return found.groupBy("doc_id").agg(F.count("*").alias("total"), *cols, F.bool_or(status == "FAIL").alias("has_failures"))


_DATE = """coalesce(CAST(try_strptime({0}, '%d %b %Y') AS DATE),
  CASE WHEN {0} LIKE '__/__/__' THEN CAST(try_strptime(substr({0}, 1, 6) || CASE WHEN substr({0}, 7) >= '69' THEN '19' ELSE '20' END || substr({0}, 7), '%d/%m/%Y') AS DATE) END)"""
_ZONE = "CASE WHEN regexp_full_match({0}, '[0-9]{{6}}') THEN CAST(try_strptime({1} || {0}, '%Y%m%d') AS DATE) END"


def sql_prepared(as_of: str) -> str:
    """Continues the SQL of the documents with relation ``r``."""
    ident = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
    tokens = "list_filter(regexp_split_to_array(upper({0}), '\\s+'), lambda t: t <> '')"
    usable = "{0} IS NOT NULL AND ({1} <> 'mrz' OR NOT has_mrz OR reliable)"
    visual = "CASE WHEN {1} = 'visual' THEN nullif(trim({0}), '') END"
    born = f"CASE WHEN 2000 + try_cast(substr({{0}}, 1, 2) AS INTEGER) > year(DATE '{as_of}') THEN '19' ELSE '20' END"
    return f""", r AS MATERIALIZED (SELECT *, DATE '{as_of}' AS as_of,
  {usable.format("date_of_birth", "dob_source")} AS dob_usable, {usable.format("issue_date", "issue_source")} AS issue_usable, {usable.format("expiry_date", "expiry_source")} AS expiry_usable,
  CASE WHEN dob_source = 'mrz' THEN {_ZONE.format("date_of_birth", born.format("date_of_birth"))} ELSE {_DATE.format("date_of_birth")} END AS dob_date,
  {_DATE.format("issue_date")} AS issue_day,
  CASE WHEN expiry_source = 'mrz' THEN {_ZONE.format("expiry_date", "'20'")} ELSE {_DATE.format("expiry_date")} END AS expiry_day,
  {_ZONE.format("mrz_dob", born.format("mrz_dob"))} AS zone_dob, {_ZONE.format("mrz_expiry", "'20'")} AS zone_expiry,
  nullif(trim(nationality), '') AS v_nationality, nullif(trim(document_number), '') AS v_number,
  {visual.format("document_number", "number_source")} AS own_number, {visual.format("name", "name_source")} AS own_name, {visual.format("date_of_birth", "dob_source")} AS own_dob,
  {visual.format("expiry_date", "expiry_source")} AS own_expiry, {visual.format("nationality", "nationality_source")} AS own_nationality,
  {tokens.format("name")} AS name_tokens, {tokens.format("given || ' ' || surname")} AS zone_tokens,
  {ident.format("nationality")} AS id_nationality, {ident.format("mrz_nationality")} AS zone_nationality,
  {ident.format("document_number")} AS id_number, {ident.format("mrz_number")} AS zone_number FROM mrz)"""


def sql_findings() -> str:
    """Relation ``f`` with the findings, rule by rule; pos counts them within a document."""
    rows: list[tuple[str, str, str, str, str, str]] = []
    ok = lambda good, bad: f"CASE WHEN coalesce({good}, false) THEN 'PASS' ELSE '{bad}' END"
    both = lambda a, b, status: f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {b} = '' THEN 'NOT_APPLICABLE' ELSE {status} END"
    add = lambda *x: rows.append(x)
    for f in REQUIRED:
        add(f"REQUIRED_{f.upper()}", "required_field", f, "true", ok(f"trim({f}) <> ''", "FAIL"), "'MEDIUM'")
    add("REQUIRED_MRZ", "required_field", "mrz", "true", ok("has_mrz", "WARNING"), "'MEDIUM'")
    for f in REQUIRED:
        add(f"FORMAT_NONEMPTY_{f.upper()}", "format", f, f"trim({f}) = ''", "'FAIL'", "'LOW'")
    add("FORMAT_NATIONALITY", "format", "nationality", "v_nationality IS NOT NULL", ok("regexp_full_match(upper(v_nationality), '[A-Z]{3}')", "WARNING"), "'LOW'")
    add("FORMAT_DOCUMENT_NUMBER_GENERIC", "format", "document_number", "v_number IS NOT NULL", ok("regexp_full_match(v_number, '[A-Za-z0-9 -]{4,20}')", "WARNING"), "'LOW'")
    uses = ("dob_usable", "issue_usable", "expiry_usable")
    dob, issue, expiry = (f"(CASE WHEN {use} THEN {day} END)" for use, day in zip(uses, ("dob_date", "issue_day", "expiry_day")))
    for f, use, day in zip(DATES, uses, (dob, issue, expiry)):
        add(f"DATE_VALID_{f.upper()}", "date", f, use, ok(f"{day} IS NOT NULL", "FAIL"), "'HIGH'")
    add("DATE_ISSUE_BEFORE_EXPIRY", "date", "issue_date", f"{issue} IS NOT NULL AND {expiry} IS NOT NULL", ok(f"{issue} < {expiry}", "FAIL"), "'HIGH'")
    add("DATE_EXPIRY_STATUS", "date", "expiry_date", f"{expiry} IS NOT NULL", ok(f"{expiry} >= as_of", "WARNING"), "'LOW'")
    add("DATE_DOB_BEFORE_ISSUE", "date", "date_of_birth", f"{dob} IS NOT NULL AND {issue} IS NOT NULL", ok(f"{dob} < {issue}", "FAIL"), "'HIGH'")
    add("MRZ_PRESENT", "mrz", "mrz", "NOT has_mrz", "'WARNING'", "'MEDIUM'")
    add("MRZ_STRUCTURE", "mrz", "mrz", "has_mrz", ok("two_lines", "FAIL"), "'MEDIUM'")
    add("MRZ_UNRELIABLE", "mrz", "mrz", "two_lines AND NOT reliable", "'WARNING'", "'MEDIUM'")
    for name, f in CHECKS.items():
        add(f"MRZ_CHECK_{name}", "mrz", f, f"reliable AND ok_{name.lower()} IS NOT NULL", ok(f"ok_{name.lower()}", "FAIL"), "'HIGH'")
    add("CONSISTENCY_MRZ", "consistency", "mrz", "NOT reliable", "'NOT_APPLICABLE'", "'INFO'")
    times = "len(list_filter({0}, lambda x: x = t))"
    within = f"len(name_tokens) > 0 AND len(list_filter(name_tokens, lambda t: {times.format('name_tokens')} > {times.format('zone_tokens')})) = 0"
    add("CONSISTENCY_NAME", "consistency", "name", "reliable", both("own_name", "(given || surname)", ok(within, "FAIL")), "'HIGH'")

    def same_day(rule: str, f: str, text: str, day: str, zone: str) -> None:
        add(f"CONSISTENCY_{rule}", "consistency", f, "reliable", f"CASE WHEN {text} IS NULL OR {zone} IS NULL THEN 'NOT_APPLICABLE' ELSE {ok(f'{day} = {zone}', 'FAIL')} END", f"CASE WHEN {day} IS NULL THEN 'MEDIUM' ELSE 'HIGH' END")

    same_day("DOB", "date_of_birth", "own_dob", "dob_date", "zone_dob")
    cut = "(id_number <> '' AND zone_number <> '' AND (starts_with(id_number, zone_number) OR starts_with(zone_number, id_number)))"
    add("CONSISTENCY_DOCUMENT_NUMBER", "consistency", "document_number", "reliable", both("own_number", "mrz_number", f"CASE WHEN id_number = zone_number THEN 'PASS' WHEN {cut} THEN 'WARNING' ELSE 'FAIL' END"), f"CASE WHEN {cut} THEN 'LOW' ELSE 'HIGH' END")
    add("CONSISTENCY_NATIONALITY", "consistency", "nationality", "reliable", both("own_nationality", "mrz_nationality", ok("id_nationality = zone_nationality", "FAIL")), "'MEDIUM'")
    same_day("EXPIRY", "expiry_date", "own_expiry", "expiry_day", "zone_expiry")
    add("PASSPORT_DOC_NUMBER_FORMAT", "passport", "document_number", "v_number IS NOT NULL", ok("regexp_full_match(id_number, '[A-Z0-9]{1,9}')", "WARNING"), "'MEDIUM'")
    add("PASSPORT_MRZ_FORMAT", "passport", "mrz", "has_mrz", ok("two_lines", "WARNING"), "'MEDIUM'")
    add("PASSPORT_MRZ_TYPE", "passport", "mrz", "reliable", ok("mrz_type = 'P'", "WARNING"), "'MEDIUM'")
    add("PASSPORT_MRZ_SEX", "passport", "sex", "reliable", ok("mrz_sex IN ('M', 'F', 'X', '<', '')", "WARNING"), "'LOW'")
    union = "\nUNION ALL ".join(f"SELECT doc_id, {i} AS o, '{rule}' AS rule_id, '{cat}' AS category, '{f}' AS field, {status} AS status, {sev} AS s FROM r WHERE {when}" for i, (rule, cat, f, when, status, sev) in enumerate(rows))
    return f""", raw AS ({union}), f AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, rule_id, category, field, status,
    CASE WHEN status IN ('PASS', 'NOT_APPLICABLE') THEN 'INFO' ELSE s END AS severity FROM raw)"""
