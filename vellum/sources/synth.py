"""Identity documents derived from the star schema by integer arithmetic: one for each customer, with defects by
the key modulo 20. A synthetic workload for the screening semantics, not reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.mrz import check_digit

# Fixed values.
SURNAMES = ("ERIKSSON", "MARTIN", "GARCIA", "NOVAK", "OKAFOR")
GIVEN = ("ANNA MARIA", "JOHN", "LUCIA", "PETER", "AMINA")
AS_OF = "2024-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents to a partition of the chain of tables.
TO_PART = 5000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many partitions the documents are dealt: more of them as there are more customers, so none grows with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "customer").count() // TO_PART))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt by key: the table may be a single file, which a single task would read and work on."""
    return table(spark, sf_dir, "customer").repartition(parts(spark, sf_dir), "c_custkey")


def _letter(x: Column) -> Column:
    return F.chr((x % 26 + 65).cast("bigint"))


def identity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the printed fields (number, nationality, name, dob, issue, expiry as text), line1, line2. Defects: 1 dob digit, 2 shifted
    line, 3 name, 4 issue after expiry, 5 no nationality, 6 no zone, 7 no dob, 8 two-digit years, 9 zone on one line, 10 number
    cut, 11 other dob, 12 impossible date, 13 low OCR, 14 no issue date, 15 no title, 16 no number, 17 no name, 18 no expiry."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    defect = k % 20
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    day = lambda base, step, span: F.date_add(F.lit(base).cast("date"), (k * step % span).cast("int"))
    base = people(spark, sf_dir).select(
        k.alias("doc_id"), defect.alias("defect"),
        F.concat(_letter(k), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")).alias("number"),
        F.concat(_letter(n), _letter(n * 7), _letter(n * 3)).alias("nationality"),
        pick(SURNAMES, k).alias("sn"), pick(GIVEN, F.floor(k / 5)).alias("gn"), pick(("M", "F", "<"), k).alias("sex"),
        day("1950-01-01", 37, 18000).alias("d_dob"), day("2015-01-01", 53, 3000).alias("d_issue"), day("2020-01-01", 71, 4000).alias("d_expiry"),
    )
    # Each step is a column of its own, which later ones read: so it is computed once.
    six = lambda c: F.date_format(c, "yyMMdd")
    base = base.withColumns({"number9": F.rpad("number", 9, "<"), "s_dob": six("d_dob"), "s_expiry": six("d_expiry")})
    base = base.withColumns({"c_number": check_digit(F.col("number9")), "c_dob": check_digit(F.col("s_dob")), "c_expiry": check_digit(F.col("s_expiry"))})
    dob_digit = F.when(F.col("defect") == 1, F.translate("c_dob", "0123456789", "1234567890")).otherwise(F.col("c_dob"))
    base = base.withColumn("body", F.concat("number9", "c_number", "nationality", "s_dob", dob_digit, "sex", "s_expiry", "c_expiry", F.lit("<" * 15)))
    base = base.withColumn("composite", check_digit(F.concat(F.substring("body", 1, 10), F.substring("body", 14, 7), F.substring("body", 22, 22))))
    line2 = F.concat("body", "composite")
    shifted = F.concat(F.substring(line2, 2, 43), F.lit("<"))
    line1 = F.rpad(F.concat(F.lit("P<"), F.col("nationality"), F.col("sn"), F.lit("<<"), F.translate("gn", " ", "<")), 44, "<")
    no = F.col("defect") == 6
    printed = lambda c: F.when(F.col("defect") == 8, F.date_format(c, "dd/MM/yy")).otherwise(F.upper(F.date_format(c, "dd MMM yyyy")))
    other = F.when(F.col("defect") == 11, F.date_add("d_dob", 1)).otherwise(F.col("d_dob"))
    dob = F.when(F.col("defect") == 12, F.lit("31 FEB 1980")).when(F.col("defect") != 7, printed(other))
    unless = lambda d, c: F.when(F.col("defect") != d, c)
    return base.select(
        "doc_id", "defect",
        unless(16, F.when(F.col("defect") == 10, F.substring("number", 1, 7)).otherwise(F.col("number"))).alias("document_number"),
        unless(5, F.col("nationality")).alias("nationality"),
        unless(17, F.when(F.col("defect") == 3, F.concat(F.lit("DOE "), F.col("sn"))).otherwise(F.concat("gn", F.lit(" "), F.col("sn")))).alias("name"),
        dob.alias("date_of_birth"),
        unless(14, printed(F.when(F.col("defect") == 4, F.date_add("d_expiry", 30)).otherwise(F.col("d_issue")))).alias("issue_date"),
        unless(18, printed(F.col("d_expiry"))).alias("expiry_date"),
        F.when(~no, line1).alias("line1"), F.when(~no, F.when(F.col("defect") == 2, shifted).otherwise(line2)).alias("line2"),
    )


def _cd(x: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, length({x}) + 1), lambda i: greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({x}, i, 1)) - 1, 0) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS VARCHAR)"


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_LETTER = "chr(CAST(({0}) % 26 + 65 AS INTEGER))"
#: The same documents in SQL, as relation ``src``.
DOCUMENTS_SQL = f"""
WITH base AS (
  SELECT c_custkey AS doc_id, c_custkey % 20 AS defect,
    {_LETTER.format("c_custkey")} || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS number,
    {_LETTER.format("c_nationkey")} || {_LETTER.format("c_nationkey * 7")} || {_LETTER.format("c_nationkey * 3")} AS nat,
    {_sql_list(SURNAMES)}[c_custkey % 5 + 1] AS sn, {_sql_list(GIVEN)}[(c_custkey // 5) % 5 + 1] AS gn, ['M', 'F', '<'][c_custkey % 3 + 1] AS sex,
    CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS DATE) AS d_dob,
    CAST(DATE '2015-01-01' + CAST(c_custkey * 53 % 3000 AS INTEGER) AS DATE) AS d_issue,
    CAST(DATE '2020-01-01' + CAST(c_custkey * 71 % 4000 AS INTEGER) AS DATE) AS d_expiry
  FROM customer),
six AS (
  SELECT *, rpad(number, 9, '<') AS n9, strftime(d_dob, '%y%m%d') AS s_dob, strftime(d_expiry, '%y%m%d') AS s_exp FROM base),
dig AS (SELECT *, {_cd("n9")} AS c_n, {_cd("s_dob")} AS c_d0, {_cd("s_exp")} AS c_e FROM six),
body AS (
  SELECT *, n9 || c_n || nat || s_dob || CASE WHEN defect = 1 THEN CAST((CAST(c_d0 AS INTEGER) + 1) % 10 AS VARCHAR) ELSE c_d0 END
    || sex || s_exp || c_e || '<<<<<<<<<<<<<<' || '<' AS body FROM dig),
comp AS (SELECT *, substr(body, 1, 10) || substr(body, 14, 7) || substr(body, 22, 22) AS cdata FROM body),
l2 AS (SELECT *, body || {_cd("cdata")} AS full2, rpad('P<' || nat || sn || '<<' || replace(gn, ' ', '<'), 44, '<') AS full1 FROM comp),
src AS (
  SELECT doc_id, defect,
    CASE WHEN defect = 16 THEN NULL WHEN defect = 10 THEN substr(number, 1, 7) ELSE number END AS document_number,
    CASE WHEN defect <> 5 THEN nat END AS nationality,
    CASE WHEN defect = 17 THEN NULL WHEN defect = 3 THEN 'DOE ' || sn ELSE gn || ' ' || sn END AS name,
    CASE WHEN defect = 12 THEN '31 FEB 1980' WHEN defect = 7 THEN NULL
      WHEN defect = 8 THEN strftime(d_dob, '%d/%m/%y')
      ELSE upper(strftime(CASE WHEN defect = 11 THEN d_dob + 1 ELSE d_dob END, '%d %b %Y')) END AS date_of_birth,
    CASE WHEN defect = 14 THEN NULL WHEN defect = 8 THEN strftime(d_issue, '%d/%m/%y')
      ELSE upper(strftime(CASE WHEN defect = 4 THEN d_expiry + 30 ELSE d_issue END, '%d %b %Y')) END AS issue_date,
    CASE WHEN defect = 18 THEN NULL WHEN defect = 8 THEN strftime(d_expiry, '%d/%m/%y') ELSE upper(strftime(d_expiry, '%d %b %Y')) END AS expiry_date,
    CASE WHEN defect <> 6 THEN full1 END AS line1,
    CASE WHEN defect = 2 THEN substr(full2, 2, 43) || '<' WHEN defect <> 6 THEN full2 END AS line2
  FROM l2)
"""
#: Continues SQL with a relation ``doc`` (doc_id, line1, line2 and more): the zone parsed, as relation ``mrz``.
ZONE_SQL = f""",
cut AS (
  SELECT * REPLACE (rpad(upper(trim(line1)), 44, '<') AS line1, rpad(upper(trim(line2)), 44, '<') AS line2), coalesce(line1, line2) IS NOT NULL AS has_mrz, line1 IS NOT NULL AND line2 IS NOT NULL AS two_lines FROM doc),
parts AS (
  SELECT *, substr(line2, 1, 9) AS p_n, substr(line2, 14, 6) AS p_d,
    substr(line2, 22, 6) AS p_e, substr(line2, 29, 14) AS p_o, substr(line2, 1, 10) || substr(line2, 14, 7) || substr(line2, 22, 22) AS p_c
  FROM cut),
chk AS (
  SELECT *, substr(line1, 1, 1) AS mrz_type, trim(replace(substr(line1, 3, 3), '<', ' ')) AS issuer,
    trim(replace(split_part(substr(line1, 6), '<<', 1), '<', ' ')) AS surname,
    trim(replace(substr(line1, 6 + instr(substr(line1, 6), '<<') + 1), '<', ' ')) AS given,
    trim(replace(p_n, '<', ' ')) AS mrz_number, trim(replace(substr(line2, 11, 3), '<', ' ')) AS mrz_nationality,
    p_d AS mrz_dob, substr(line2, 21, 1) AS mrz_sex, p_e AS mrz_expiry, p_o AS mrz_optional,
    {_cd("p_n")} = substr(line2, 10, 1) AS ok_number, {_cd("p_d")} = substr(line2, 20, 1) AS ok_dob,
    {_cd("p_e")} = substr(line2, 28, 1) AS ok_expiry,
    CASE WHEN substr(line2, 43, 1) <> '<' THEN {_cd("p_o")} = substr(line2, 43, 1) END AS ok_optional,
    {_cd("p_c")} = substr(line2, 44, 1) AS ok_composite
  FROM parts),
mrz AS MATERIALIZED (
  SELECT *, coalesce(two_lines AND (ok_number OR ok_dob OR ok_expiry OR coalesce(ok_optional, false)), false) AS reliable FROM chk)
"""
