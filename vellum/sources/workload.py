"""Further synthetic inputs, by integer arithmetic on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.numbers import half_even_sql
from vellum.sources.synth import people


def page_words(docs: DataFrame) -> DataFrame:
    """The words on the page of each identity document. A date stands after its label, below it, or beside it on its row, by the id
    modulo 3; the zone is merged into one line by defect 9, half of these with a serial number below it, as all others have."""
    k = F.col("doc_id")
    label = lambda t, c: F.rtrim(F.concat(F.lit(t), F.coalesce(F.col(c), F.lit(""))))
    at = lambda text, x, y: F.struct(text.alias("line"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    merged = F.col("defect") == 9
    rows = [
        at(F.when(F.col("defect") == 15, "IDENTITY PAPER").otherwise("PASSPORT"), 100, 0), at(label("PASSPORT NO ", "document_number"), 100, 50),
        at(label("NATIONALITY ", "nationality"), 100, 100), at(F.when(k % 2 == 0, label("SURNAME: ", "name")).otherwise(label("Surname / Nom ", "name")), 100, 150),
    ]
    for i, (text, c) in enumerate((("DATE OF BIRTH", "date_of_birth"), ("DATE OF ISSUE", "issue_date"), ("DATE OF EXPIRY", "expiry_date"))):
        y = 200 + 100 * i
        rows += [at(F.when(k % 3 == 0, label(f"{text} ", c)).otherwise(F.lit(text)), 100, y), at(F.when(k % 3 == 1, F.col(c)), 100, y + 40), at(F.when(k % 3 == 2, F.col(c)), 500, y)]
    rows += [at(F.when(merged, F.concat("line1", "line2")).otherwise(F.col("line1")), 100, 600), at(F.when(~merged, F.col("line2")), 100, 640)]
    rows.append(at(F.when(~merged | (k % 40 == 9), "SERIAL0123456789012345678"), 100, 700))
    line = docs.select("doc_id", "defect", F.posexplode(F.array(*rows)).alias("line_id", "l")).where("l.line is not null")
    word = line.select("doc_id", "defect", "line_id", "l.*", F.posexplode(F.split("l.line", " ")).alias("word_pos", "text")).where("text <> ''")
    before = F.when(F.col("word_pos") > 0, F.length(F.array_join(F.slice(F.split("line", " "), F.lit(1), F.greatest("word_pos", F.lit(1))), " ")) + 1).otherwise(0)
    x = F.col("x") + 12 * before
    return word.select("doc_id", "line_id", "word_pos", "text", F.when(F.col("defect") == 13, 0.4).otherwise(0.95).alias("confidence"), x.alias("x1"), F.col("y").alias("y1"), (x + 12 * F.length("text")).alias("x2"), (F.col("y") + 30).alias("y2"))


def document_words(docs: DataFrame) -> DataFrame:
    """The words of each text with a place on a page and a confidence, by arithmetic."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_id", "line"))
    word = line.select("doc_id", "line_id", F.posexplode(F.split("line", " ")).alias("word_pos", "text")).where(F.col("text") != "")
    x, y = F.col("word_pos") * 50, F.col("line_id") * 40
    return word.select("doc_id", "line_id", "word_pos", "text", ((F.length("text") * 7) % 100 / 100).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + F.length("text") * 8).alias("x2"), (y + 30).alias("y2"))


def document_lines(docs: DataFrame) -> DataFrame:
    """The same words as a page a row, (doc_id, lines) with lines of (line_id, words)."""
    y = lambda i: i * 40
    word = lambda w, j, i: F.struct((j * 50).alias("x1"), j.alias("word_pos"), w.alias("text"), ((F.length(w) * 7) % 100 / 100).alias("confidence"), y(i).alias("y1"), (j * 50 + F.length(w) * 8).alias("x2"), (y(i) + 30).alias("y2"))
    line = lambda t, i: F.struct(i.alias("line_id"), F.filter(F.transform(F.split(t, " "), lambda w, j: word(w, j, i)), lambda w: w["text"] != "").alias("words"))
    return docs.select("doc_id", F.transform(F.split("text", "\n"), line).alias("lines"))


def forensic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers of each document; the engine had nothing for every 41st."""
    k, n = F.col("doc_id"), F.col("layer")
    rows = people(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("layer"))
    box = lambda *x: F.array(*map(F.lit, x))
    return rows.select(
        "doc_id", "layer", F.concat(F.lit("layer"), n.cast("string")).alias("layer_name"), (k * (n + 3) % 7 != 0).alias("passed"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("severity"),
        (0.5 + (k % 5) / 10).alias("confidence"),
        F.when(n == 1, box(110, 305, 390, 338)).when(n == 2, box(400, 100, 600, 300)).alias("region"),
        F.when(k % 31 == n, "error").otherwise("ok").alias("status"),
        F.when(k % 37 == n, "calibration_missing").when((k % 11 == 0) & (n == 1), "normal").otherwise("anomaly").alias("finding_type"),
    ).where(k % 41 != 0)


def face_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), (i % len(names) + 1).cast("int"))
    return people(spark, sf_dir).select(
        k.alias("doc_id"), pick(("MATCH", "MATCH", "MISMATCH", "UNAVAILABLE", "MATCH", "NO_FACE"), k).alias("status"),
        pick(("HIGH", "MEDIUM", "LOW"), k).alias("strength"), F.when(pick(("MATCH", "MATCH", "MISMATCH", "UNAVAILABLE", "MATCH", "NO_FACE"), k).isin("MATCH", "MISMATCH"), k % 1000 / 1000).alias("similarity"), F.array(F.lit(400), F.lit(100), F.lit(600), F.lit(300)).alias("region"),
    )


LAYERS_SQL = """SELECT c_custkey AS doc_id, layer, 'layer' || layer AS layer_name, c_custkey * (layer + 3) % 7 <> 0 AS passed,
  ['low', 'medium', 'high'][c_custkey % 3 + 1] AS severity, 0.5::DOUBLE + (c_custkey % 5)::DOUBLE / 10 AS confidence,
  CASE layer WHEN 1 THEN [110, 305, 390, 338] WHEN 2 THEN [400, 100, 600, 300] END AS region,
  CASE WHEN c_custkey % 31 = layer THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 37 = layer THEN 'calibration_missing' WHEN c_custkey % 11 = 0 AND layer = 1 THEN 'normal' ELSE 'anomaly' END AS finding_type
FROM customer, (SELECT unnest([1, 2, 3, 4]) AS layer) WHERE c_custkey % 41 <> 0"""
_DATE_ROWS = ", ".join(
    f"(CASE WHEN doc_id % 3 = 0 THEN rtrim('{text} ' || coalesce({c}, '')) ELSE '{text}' END, 100, {y}), (CASE WHEN doc_id % 3 = 1 THEN {c} END, 100, {y + 40}), (CASE WHEN doc_id % 3 = 2 THEN {c} END, 500, {y})"
    for text, c, y in (("DATE OF BIRTH", "date_of_birth", 200), ("DATE OF ISSUE", "issue_date", 300), ("DATE OF EXPIRY", "expiry_date", 400))
)
_ROWS = f"""(CASE WHEN defect = 15 THEN 'IDENTITY PAPER' ELSE 'PASSPORT' END, 100, 0), (rtrim('PASSPORT NO ' || coalesce(document_number, '')), 100, 50),
    (rtrim('NATIONALITY ' || coalesce(nationality, '')), 100, 100), (CASE WHEN doc_id % 2 = 0 THEN rtrim('SURNAME: ' || coalesce(name, '')) ELSE rtrim('Surname / Nom ' || coalesce(name, '')) END, 100, 150),
    {_DATE_ROWS}, (CASE WHEN defect = 9 THEN line1 || line2 ELSE line1 END, 100, 600), (CASE WHEN defect <> 9 THEN line2 END, 100, 640),
    (CASE WHEN defect <> 9 OR doc_id % 40 = 9 THEN 'SERIAL0123456789012345678' END, 100, 700)"""


def _dates_sql() -> str:
    """Relation ``dates`` from lines ``ln``: what each field claims, one field after the other, first on its label's line, then near it."""
    labels = {"date_of_birth": "birth|dob", "issue_date": "issue|issued", "expiry_date": "expiry|expiration|expire|valid until"}
    out, taken = [], ["SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS line_pos WHERE false"]
    free = lambda: f"NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(taken)}) t WHERE t.doc_id = l.doc_id AND t.line_pos = l.line_pos)"
    for k, (f, pattern) in enumerate(labels.items()):
        out.append(f"own{k} AS MATERIALIZED (SELECT doc_id, min(line_pos) AS line_pos FROM dated l WHERE date IS NOT NULL AND regexp_matches(lower(text), '{pattern}') AND {free()} GROUP BY doc_id)")
        taken.append(f"SELECT doc_id, line_pos FROM own{k}")
    for k, (f, pattern) in enumerate(labels.items()):
        out.append(f"""near{k} AS MATERIALIZED (SELECT doc_id, line_pos FROM (
  SELECT l.doc_id, l.line_pos, row_number() OVER (PARTITION BY l.doc_id ORDER BY kind, CASE kind WHEN 0 THEN greatest(l.x1 - a.x2, 0) ELSE l.y1 - a.y2 + abs(l.x1 - a.x1) * 0.25 END, l.line_pos) AS r
  FROM (SELECT l.*, CASE WHEN ((a.y1 + a.y2) / 2.0 BETWEEN l.y1 AND l.y2 OR (l.y1 + l.y2) / 2.0 BETWEEN a.y1 AND a.y2) AND l.x1 >= a.x1 THEN 0
      WHEN l.y1 >= (a.y1 + a.y2) / 2.0 AND l.y1 - a.y2 <= 3 * greatest(a.y2 - a.y1, 1) THEN 1 END AS kind, a AS a
    FROM dated l JOIN (SELECT d.* FROM dated d JOIN (SELECT doc_id, min(line_pos) AS p FROM dated WHERE regexp_matches(lower(text), '{pattern}') GROUP BY doc_id) m ON d.doc_id = m.doc_id AND d.line_pos = m.p
      WHERE d.doc_id NOT IN (SELECT doc_id FROM own{k})) a ON l.doc_id = a.doc_id AND l.line_pos <> a.line_pos
    WHERE l.date IS NOT NULL AND {free()}) l WHERE kind IS NOT NULL) WHERE r = 1)""")
        taken.append(f"SELECT doc_id, line_pos FROM near{k}")
    union = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, line_pos FROM {t}{k}" for k, f in enumerate(labels) for t in ("own", "near"))
    return f"""dated AS MATERIALIZED (SELECT *, nullif(regexp_extract(upper(text), '\\b(\\d{{1,2}}[ /.\\-][A-Z]{{3}}[ /.\\-]\\d{{2,4}}|\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}|\\d{{4}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{1,2}})\\b', 1), '') AS date FROM ln),
{", ".join(out)},
dates AS (SELECT u.doc_id, u.field, d.date AS value, d.confidence, [d.x1, d.y1, d.x2, d.y2] AS box FROM ({union}) u JOIN dated d ON u.doc_id = d.doc_id AND u.line_pos = d.line_pos)"""


#: Continues ``src`` to its lines ``ln``, the zone's pair ``zone``, and the words' number and mean confidence.
LINES_SQL = f""", page AS (SELECT doc_id, defect, unnest(range(0, 16)) AS line_id, unnest([{_ROWS}]) AS l FROM src),
ln AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l[3], line_id) - 1 AS line_pos, l[1] AS text, CASE WHEN defect = 13 THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
  l[2] AS x1, l[3] AS y1, l[2] + 12 * length(l[1]) AS x2, l[3] + 30 AS y2, len(string_split(l[1], ' ')) AS n FROM page WHERE l[1] IS NOT NULL),
ocr AS (SELECT doc_id, CASE WHEN min(confidence) < 0.5 THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS ocr_confidence, CAST(sum(n) AS BIGINT) AS words FROM ln GROUP BY doc_id),
cand AS (SELECT doc_id, line_pos, regexp_replace(upper(text), '\\s+', '', 'g') AS candidate, x1, y1, x2, y2 FROM ln WHERE regexp_full_match(regexp_replace(upper(text), '\\s+', '', 'g'), '[A-Z0-9<]{{25,}}')),
ranked AS (SELECT *, length(candidate) BETWEEN 38 AND 48 AS fit, count(*) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (length(candidate) BETWEEN 38 AND 48) OVER (PARTITION BY doc_id) AS fits,
  row_number() OVER (PARTITION BY doc_id ORDER BY line_pos DESC) AS back, row_number() OVER (PARTITION BY doc_id, length(candidate) BETWEEN 38 AND 48 ORDER BY line_pos DESC) AS fit_back FROM cand),
chosen AS (SELECT * FROM ranked WHERE CASE WHEN fits >= 2 THEN fit AND fit_back <= 2 ELSE back <= 2 END),
zone AS MATERIALIZED (SELECT doc_id, CASE WHEN max(n) = 1 AND max(length(candidate)) BETWEEN 76 AND 96 THEN left(max(candidate), max(length(candidate)) // 2) ELSE arg_min(candidate, line_pos) END AS line1,
  CASE WHEN max(n) = 1 AND max(length(candidate)) BETWEEN 76 AND 96 THEN substr(max(candidate), max(length(candidate)) // 2 + 1) WHEN count(*) = 2 THEN arg_max(candidate, line_pos) END AS line2,
  [min(x1), min(y1), max(x2), max(y2)] AS zone_box FROM chosen GROUP BY doc_id)"""
#: Continues it to the fields, the documents ``doc`` made of them, the parsed zone ``mrz``, and the regions ``region_of``.
FIELDS_SQL = f""", {_dates_sql()},
texts AS (SELECT doc_id, line_pos, confidence, [x1, y1, x2, y2] AS box, unnest([{{'field': 'document_number', 'value': CASE WHEN regexp_matches(upper(text), 'PASSPORT|\\bNO\\b|\\bNUMBER\\b') THEN nullif(regexp_extract(upper(text), '\\b([A-Z]{{1,2}}[0-9]{{6,8}}|[0-9]{{7,9}})\\b', 1), '') END}},
    {{'field': 'nationality', 'value': CASE WHEN contains(upper(text), 'NATIONAL') THEN nullif(regexp_extract(upper(text), '\\b([A-Z]{{3}})\\b', 1), '') END}},
    {{'field': 'name', 'value': CASE WHEN contains(upper(text), 'SURNAME') OR starts_with(upper(trim(text)), 'NAME') THEN nullif(trim(regexp_extract(trim(text), '[:\\-]?\\s*([A-Z][A-Z ]{{2,}})$', 1)), '') END}}]) AS f FROM ln),
printed AS (SELECT doc_id, field, value, confidence, box, 'visual' AS source FROM dates
  UNION ALL SELECT doc_id, f.field, arg_min(f.value, line_pos), arg_min(confidence, line_pos), arg_min(box, line_pos), 'visual' FROM texts WHERE f.value IS NOT NULL GROUP BY doc_id, f.field),
pre AS (SELECT doc_id, rpad(line1, 44, '<') AS a, rpad(line2, 44, '<') AS b, zone_box FROM zone WHERE line2 IS NOT NULL),
named AS (SELECT *, trim(replace(split_part(substr(a, 6), '<<', 1), '<', ' ')) AS sn, CASE WHEN contains(substr(a, 6), '<<') THEN trim(replace(substr(a, 6 + instr(substr(a, 6), '<<') + 1), '<', ' ')) ELSE '' END AS gn FROM pre),
zoned AS (SELECT doc_id, zone_box, unnest([{{'field': 'name', 'value': trim(gn || ' ' || sn)}}, {{'field': 'document_number', 'value': trim(replace(substr(b, 1, 9), '<', ' '))}}, {{'field': 'nationality', 'value': trim(replace(substr(b, 11, 3), '<', ' '))}},
    {{'field': 'date_of_birth', 'value': trim(replace(substr(b, 14, 6), '<', ' '))}}, {{'field': 'expiry_date', 'value': trim(replace(substr(b, 22, 6), '<', ' '))}}]) AS f FROM named),
fields AS MATERIALIZED (SELECT * FROM printed
  UNION ALL SELECT doc_id, f.field, f.value, 0.9::DOUBLE, zone_box, 'mrz' FROM zoned WHERE f.value <> '' AND NOT EXISTS (SELECT 1 FROM printed p WHERE p.doc_id = zoned.doc_id AND p.field = zoned.f.field)),
doc AS (SELECT o.doc_id, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}, max(source) FILTER (field = '{f}') AS {s}" for f, s in (("document_number", "number_source"), ("nationality", "nationality_source"), ("name", "name_source"), ("date_of_birth", "dob_source"), ("issue_date", "issue_source"), ("expiry_date", "expiry_source")))},
  any_value(z.line1) AS line1, any_value(z.line2) AS line2, any_value(ocr_confidence) AS ocr_confidence, any_value(words) AS words
  FROM ocr o LEFT JOIN fields f ON o.doc_id = f.doc_id LEFT JOIN zone z ON o.doc_id = z.doc_id GROUP BY o.doc_id),
region_of AS (SELECT doc_id, field, box AS region FROM fields UNION ALL SELECT doc_id, 'mrz', zone_box FROM zone)"""

FACES_SQL = """SELECT c_custkey AS doc_id, ['MATCH', 'MATCH', 'MISMATCH', 'UNAVAILABLE', 'MATCH', 'NO_FACE'][c_custkey % 6 + 1] AS status,
  ['HIGH', 'MEDIUM', 'LOW'][c_custkey % 3 + 1] AS strength, [400, 100, 600, 300] AS region FROM customer"""
#: Continues the findings' SQL with the items of all sources, their pairs, and the risk.
EVIDENCE_SQL = f""", items AS MATERIALIZED (
  SELECT doc_id, pos, 'rules:' || rule_id AS id, 'rules' AS source,
    CASE status WHEN 'PASS' THEN 'REASSURING' WHEN 'NOT_APPLICABLE' THEN 'NEUTRAL' ELSE 'CONCERN' END AS polarity,
    severity, 1.0::DOUBLE AS confidence, field,
    region, rule_id AS finding_type
  FROM f LEFT JOIN region_of USING (doc_id, field)
  UNION ALL
  SELECT doc_id, layer + 1000, 'forensics:' || layer_name, 'forensics', p, CASE WHEN p = 'CONCERN' THEN upper(coalesce(severity, 'medium')) ELSE 'INFO' END,
    confidence, CASE WHEN p = 'CONCERN' AND region IS NOT NULL THEN 'photo' END, region, finding_type
  FROM (SELECT *, CASE WHEN status = 'error' OR finding_type = 'calibration_missing' THEN 'NEUTRAL' WHEN passed OR finding_type = 'normal' THEN 'REASSURING' ELSE 'CONCERN' END AS p FROM ({LAYERS_SQL}))
  UNION ALL
  SELECT doc_id, 1000, 'forensics:unavailable', 'forensics', 'NEUTRAL', 'INFO', 0.0, NULL, NULL, 'unavailable' FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM ({LAYERS_SQL}))
  UNION ALL
  SELECT doc_id, 2000, 'biometrics:' || status, 'biometrics',
    CASE status WHEN 'MATCH' THEN 'REASSURING' WHEN 'MISMATCH' THEN 'CONCERN' ELSE 'NEUTRAL' END,
    CASE WHEN status <> 'MISMATCH' THEN 'INFO' WHEN strength = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END,
    CASE WHEN status NOT IN ('MATCH', 'MISMATCH') THEN 0.0 WHEN strength = 'HIGH' THEN 0.95 WHEN strength = 'MEDIUM' THEN 0.8 WHEN strength = 'LOW' THEN 0.6 ELSE 0.7 END,
    CASE status WHEN 'MATCH' THEN 'photo' WHEN 'MISMATCH' THEN 'identity' END, region, status
  FROM ({FACES_SQL})
  UNION ALL
  SELECT doc_id, 3000, 'ocr:confidence', 'ocr', CASE WHEN ocr_confidence < 0.5 AND words > 0 THEN 'CONCERN' ELSE 'NEUTRAL' END,
    CASE WHEN ocr_confidence < 0.5 AND words > 0 THEN 'LOW' ELSE 'INFO' END, ocr_confidence, NULL, NULL, 'ocr_confidence' FROM doc),
side AS (SELECT * FROM items WHERE polarity IN ('CONCERN', 'REASSURING')),
met AS (
  SELECT a.doc_id, a.id AS id_a, b.id AS id_b, b.polarity AS pb, coalesce(a.field, b.field) AS field
  FROM side a JOIN side b ON a.doc_id = b.doc_id AND a.field = b.field AND a.source <> b.source
  WHERE a.polarity = 'CONCERN' AND (b.polarity = 'REASSURING' OR a.pos < b.pos)
  UNION
  SELECT doc_id, id_a, id_b, pb, field FROM (
    SELECT a.doc_id, a.id AS id_a, b.id AS id_b, b.polarity AS pb, coalesce(a.field, b.field) AS field,
      greatest(least(a.region[3], b.region[3]) - greatest(a.region[1], b.region[1]), 0) * greatest(least(a.region[4], b.region[4]) - greatest(a.region[2], b.region[2]), 0) AS inter,
      (a.region[3] - a.region[1]) * (a.region[4] - a.region[2]) + (b.region[3] - b.region[1]) * (b.region[4] - b.region[2]) AS areas
    FROM side a JOIN side b ON a.doc_id = b.doc_id AND a.source <> b.source
    WHERE a.region IS NOT NULL AND b.region IS NOT NULL AND a.polarity = 'CONCERN' AND (b.polarity = 'REASSURING' OR a.pos < b.pos))
  WHERE inter::DOUBLE / nullif(areas - inter, 0) > 0.1),
pair AS (
  SELECT doc_id, CASE WHEN pb = 'CONCERN' THEN 'CORROBORATION' ELSE 'CONTRADICTION' END AS type, field, id_a, id_b FROM met),
raws AS (
  SELECT *, CASE WHEN polarity = 'CONCERN' THEN
    CASE severity WHEN 'INFO' THEN 0.0::DOUBLE WHEN 'LOW' THEN 5.0::DOUBLE WHEN 'MEDIUM' THEN 12.0::DOUBLE WHEN 'HIGH' THEN 25.0::DOUBLE ELSE 40.0::DOUBLE END
    * CASE source WHEN 'forensics' THEN 0.8::DOUBLE WHEN 'ocr' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * (0.5::DOUBLE + 0.5::DOUBLE * confidence) END AS raw FROM items),
w AS MATERIALIZED (SELECT *, {half_even_sql("raw", 2)} AS points FROM raws),
bons AS (
  SELECT p.doc_id, list_reduce(list_prepend(0.0::DOUBLE, list(0.5::DOUBLE * (a.raw + b.raw) ORDER BY a.pos, b.pos)), lambda s, x: s + x) AS folded, 2 * count(*) AS ends
  FROM pair p JOIN w a ON p.doc_id = a.doc_id AND p.id_a = a.id JOIN w b ON p.doc_id = b.doc_id AND p.id_b = b.id WHERE p.type = 'CORROBORATION' GROUP BY p.doc_id),
bon AS (SELECT doc_id, {half_even_sql("folded", 2)} AS bonus, ends FROM bons),
sums AS (
  SELECT doc_id, list_reduce(list_prepend(0.0::DOUBLE, coalesce(list(points ORDER BY pos) FILTER (polarity = 'CONCERN'), [])), lambda s, x: s + x) AS folded, count(*) FILTER (polarity = 'CONCERN') AS n_concern FROM w GROUP BY doc_id),
top AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY o) AS top3 FROM (
    SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) AS o FROM w WHERE polarity = 'CONCERN') WHERE o <= 3 GROUP BY doc_id),
added AS (
  SELECT s.doc_id, s.folded, coalesce(bonus, 0.0::DOUBLE) AS bonus, s.folded + coalesce(bonus, 0.0::DOUBLE) AS total, n_concern, coalesce(ends, 0) AS ends, coalesce(top3, '') AS top3
  FROM sums s LEFT JOIN bon ON s.doc_id = bon.doc_id LEFT JOIN top ON s.doc_id = top.doc_id),
scored AS (SELECT doc_id, {half_even_sql("folded", 2)} AS base, bonus, n_concern, ends, top3, CAST(least({half_even_sql("total", 0)}, 100) AS INTEGER) AS score FROM added),
risk AS (
  SELECT doc_id, base, bonus, score, CASE WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS level,
    n_concern, CAST(ends // 2 AS BIGINT) AS n_corroboration,
    CASE WHEN score >= 35 THEN CASE WHEN ends > 0 THEN 'ESCALATE' ELSE 'ENHANCED_VERIFICATION' END
      WHEN score >= 15 OR n_concern > 0 THEN 'MANUAL_REVIEW' ELSE 'NO_ADDITIONAL_ACTION' END AS action, top3
  FROM scored)"""
