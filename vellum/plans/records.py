"""Queries of what is stored of a screening: records, files and ledger in one commit, rules by type, uploads, work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import ledger, rules, signals, text
from vellum.plans import registry as r
from vellum.plans.registry import kept, query, table
from vellum.sources import commits, store, workload

#: Screenings in a block.
IN_BLOCK = 25


@kept("files")
def evidence_files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, kind, sha256, size) of what each screening was made from: the page as it was read, and the zone where there is one."""
    page = text.full_text(r.page(spark, d)).select("doc_id", F.lit("document").alias("kind"), F.col("full_text").alias("content"))
    zone = r.zones(spark, d).select("doc_id", F.lit("zone").alias("kind"), F.concat_ws("\n", "line1", "line2").alias("content"))
    return page.unionByName(zone).select("doc_id", "kind", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"))


@kept("records")
def records(spark: SparkSession, d: str) -> DataFrame:
    """A row a screening: the 14 columns that are queried, the whole result as JSON, and its fingerprint."""
    box = r.page(spark, d).groupBy("doc_id").agg(F.max("x2").cast("int").alias("image_width"), F.max("y2").cast("int").alias("image_height"))
    kind = text.classified(r.page(spark, d), r.zones(spark, d)).select("doc_id", F.col("type").alias("document_type"), F.col("confidence").alias("document_type_confidence"))
    failures = rules.summary(r.found(spark, d)).select("doc_id", F.col("has_failures").alias("rules_has_failures"))
    layers = workload.forensic_layers(spark, d).groupBy("doc_id").agg(F.count_if(~F.col("passed")).alias("flagged"))
    faces = workload.face_checks(spark, d).select("doc_id", F.col("status").alias("biometric_status"), F.col("similarity").alias("biometric_similarity"))
    model = r.model_answers(spark, d).select("doc_id", F.when(F.col("parsed"), "COMPLETED").otherwise("ERROR").alias("llm_status"))
    items = r.items(spark, d).select("doc_id", F.struct("pos", "id", "source", "severity", "polarity", "confidence", "field", "region", "message").alias("i"))
    evidence = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: x.dropFields("pos")).alias("evidence"))
    told = r.explained(spark, d).select("doc_id", "overall", "rationale", "reasoning", "reasons", "based_on", "targets")
    rows = r.scored(spark, d).select("doc_id", F.col("level").alias("risk_level"), F.col("score").alias("risk_score"), F.col("action").alias("recommendation"), F.col("n_concern").cast("int").alias("concern_count"), "base", "bonus")
    for part in (box, kind, failures, layers, faces, model, evidence, told):
        rows = rows.join(part, "doc_id", "left")
    rows = rows.withColumns({
        "forensic_status": F.when(F.col("flagged").isNotNull(), "COMPLETED").otherwise("UNAVAILABLE"), "forensic_flagged_count": F.coalesce("flagged", F.lit(0)).cast("int"),
        "document": F.struct(F.col("document_type").alias("type"), F.col("document_type_confidence").alias("confidence"), F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height")).alias("image")),
        "risk": F.struct(F.col("risk_level").alias("level"), F.col("risk_score").alias("score"), "base", "bonus", "rationale"),
        "biometrics": F.struct(F.col("biometric_status").alias("status"), F.col("biometric_similarity").alias("similarity")),
        "explanation": F.struct("overall", "reasoning"), "advice": F.struct(F.col("recommendation").alias("action"), "reasons", "based_on", "targets"),
    })
    whole = ("doc_id", "document", "risk", "biometrics", "evidence", "explanation", "advice")
    rows = rows.withColumn("full_result", ledger.canonical(rows, *whole))
    columns = ("document_type", "document_type_confidence", "image_width", "image_height", "risk_level", "risk_score", "recommendation", "concern_count", "rules_has_failures", "forensic_status", "forensic_flagged_count", "biometric_status", "biometric_similarity", "llm_status")
    return rows.select("doc_id", *columns, "full_result", F.sha2("full_result", 256).alias("fingerprint"))


_TEXT = "'\"' || replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
_OR_NULL = "coalesce({0}, 'null')"


def _list(column: str, cut: str = "|") -> str:
    return f"'[' || coalesce('\"' || replace(nullif({column}, ''), '{cut}', '\",\"') || '\"', '') || ']'"


_RECORDS = r._TOLD + f""", box AS (SELECT doc_id, max(x2)::INTEGER AS width, max(y2)::INTEGER AS height FROM ln GROUP BY doc_id),
kind AS (SELECT l.doc_id, CASE WHEN w AND coalesce(z, false) THEN 0.98::DOUBLE WHEN w OR coalesce(z, false) THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS confidence
  FROM (SELECT doc_id, bool_or(regexp_matches(upper(text), 'PASSPORT|PASSEPORT|PASAPORTE')) AS w FROM ln GROUP BY doc_id) l LEFT JOIN (SELECT doc_id, line2 IS NOT NULL AND starts_with(upper(line1), 'P') AS z FROM zone) USING (doc_id)),
failures AS (SELECT doc_id, bool_or(status = 'FAIL') AS failed FROM f GROUP BY doc_id),
layers AS (SELECT doc_id, count(*) FILTER (NOT passed)::INTEGER AS flagged FROM ({workload.LAYERS_SQL}) GROUP BY doc_id),
face AS (SELECT doc_id, status, CASE WHEN status IN ('MATCH', 'MISMATCH') THEN doc_id % 1000 / 1000.0::DOUBLE END AS similarity FROM ({workload.FACES_SQL})),
listed AS (SELECT doc_id, string_agg('{{"confidence":' || confidence || ',"field":' || {_OR_NULL.format(_TEXT.format("field"))} || ',"id":' || {_TEXT.format("id")} || ',"message":' || {_TEXT.format("substr(told, instr(told, ']') + 2)")} || ',"polarity":"' || polarity || '","region":'
  || coalesce('[' || array_to_string(region, ',') || ']', 'null') || ',"severity":"' || severity || '","source":"' || source || '"}}', ',' ORDER BY pos) AS evidence FROM said GROUP BY doc_id),
lines AS (SELECT doc_id, concat_ws('|', coalesce(lines, 'no concern'), CASE WHEN bonus > 0 THEN 'agreement of engines, ' || printf('%.1f', bonus) || ' points' END, mixed, CASE WHEN missing <> '' THEN 'without ' || missing || ', which says nothing' END, 'in all: ' || rationale) AS reasoning,
  level || ' priority of review, score ' || score || ' of 100. It supports a decision and makes none.' AS overall,
  concat_ws('|', CASE WHEN action = 'NO_ADDITIONAL_ACTION' THEN 'nothing of weight was found' ELSE array_to_string(told[1:3], '|') END, CASE WHEN backed IS NOT NULL THEN 'several engines agree on a concern' END, CASE WHEN missing <> '' THEN 'without evidence of ' || missing END) AS reasons,
  concat_ws('|', own_ids, backed) AS based FROM told),
rec AS MATERIALIZED (SELECT t.doc_id, 'passport' AS document_type, k.confidence AS document_type_confidence, b.width AS image_width, b.height AS image_height, t.level AS risk_level, t.score AS risk_score, t.action AS recommendation, t.n_concern::INTEGER AS concern_count, fl.failed AS rules_has_failures,
    CASE WHEN y.doc_id IS NULL THEN 'UNAVAILABLE' ELSE 'COMPLETED' END AS forensic_status, coalesce(y.flagged, 0) AS forensic_flagged_count, fc.status AS biometric_status, fc.similarity AS biometric_similarity, CASE WHEN t.doc_id % 7 <> 0 THEN 'COMPLETED' ELSE 'ERROR' END AS llm_status,
    '{{"advice":{{"action":"' || t.action || '","based_on":' || {_list("l.based")} || ',"reasons":' || {_list("l.reasons")} || ',"targets":' || {_list("t.targets")} || '}},"biometrics":{{"similarity":' || coalesce(CAST(fc.similarity AS VARCHAR), 'null') || ',"status":"' || fc.status || '"}},"doc_id":' || t.doc_id
    || ',"document":{{"confidence":' || k.confidence || ',"image":{{"height":' || b.height || ',"width":' || b.width || '}},"type":"passport"}},"evidence":[' || e.evidence || '],"explanation":{{"overall":' || {_TEXT.format("l.overall")} || ',"reasoning":' || {_list("l.reasoning")} || '}},"risk":{{"base":' || t.base || ',"bonus":' || t.bonus
    || ',"level":"' || t.level || '","rationale":' || {_TEXT.format("t.rationale")} || ',"score":' || t.score || '}}}}' AS full_result
  FROM told t JOIN box b USING (doc_id) JOIN kind k USING (doc_id) JOIN failures fl USING (doc_id) LEFT JOIN layers y USING (doc_id) JOIN face fc USING (doc_id) JOIN listed e USING (doc_id) JOIN lines l USING (doc_id)),
files AS (SELECT doc_id, 'document' AS kind, string_agg(text, chr(10) ORDER BY line_pos) AS content FROM ln GROUP BY doc_id UNION ALL SELECT doc_id, 'zone', concat_ws(chr(10), line1, line2) FROM zone)"""


@query("analysis_records", _RECORDS + "SELECT * EXCLUDE (full_result), sha256(full_result) AS fingerprint FROM rec")
def analysis_records(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).drop("full_result")


@query("result_fingerprint", _RECORDS + "SELECT doc_id, full_result, sha256(full_result) AS fingerprint FROM rec")
def result_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The canonical JSON of whole results, with floats in nested records, and its hash."""
    return records(spark, d).select("doc_id", "full_result", "fingerprint")


def screening_transactions(rows: DataFrame, files: DataFrame, first: int) -> DataFrame:
    """A ledger entry a record, IN_BLOCK to a block from ``first`` on: fingerprints and the outcome, nothing of the person."""
    by = files.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "sha256"))).alias("evidence"))
    payload = F.struct("evidence", "recommendation", F.col("fingerprint").alias("result_sha256"), "risk_level", "risk_score")
    made = rows.join(by, "doc_id", "left").select(
        F.lit("screening.created").alias("action"), F.lit(None).cast("string").alias("actor"), payload.alias("payload"), F.col("doc_id").cast("string").alias("subject_id"), F.lit("analysis").alias("subject_type"),
        F.lit("2024-06-01T00:00:00").alias("timestamp"), (F.col("doc_id") % IN_BLOCK).cast("int").alias("tx_index"), F.floor(F.col("doc_id") / IN_BLOCK).alias("batch"),
    )
    return ledger.with_hash(ledger.numbered(made, "batch", "block_index", first=first).drop("batch"))


def commit_screenings(spark: SparkSession, root: str, rows: DataFrame, files: DataFrame, token: str, before_publish=None) -> int:
    """Store records, their files, and the blocks that vouch for them, in one commit after the last: a repeated token changes nothing,
    and a failure before the end leaves nothing that a reader sees."""
    done = commits.versions(spark, root)
    last, head = (done[-1]["number"], None) if done else (0, None)
    if done:
        top = commits.committed(spark, root, "blocks").agg(F.max_by(F.struct("block_index", "hash"), "block_index").alias("h")).first()["h"]
        head = (top["block_index"], top["hash"])
    made = store.written(screening_transactions(rows, files, head[0] + 1 if head else 1), "entries")
    blocks = ledger.sealed(ledger.blocks(made), head)
    return commits.commit(spark, root, {"analyses": rows, "files": files, "transactions": made, "blocks": blocks}, token, after=last, before_publish=before_publish)


@kept("store-root")
def stored(spark: SparkSession, d: str) -> DataFrame:
    """(root) of a store to which the screenings were committed in two parts."""
    root = f"{store.shared_dir(spark)}/screenings-{uuid.uuid4().hex}"
    rows, files = records(spark, d), evidence_files(spark, d)
    middle = rows.agg(F.max("doc_id")).first()[0] or 0
    for k, part in enumerate(("doc_id <= {0}", "doc_id > {0}")):
        cut = part.format(middle // (2 * IN_BLOCK) * IN_BLOCK - 1)
        commit_screenings(spark, root, rows.where(cut), files.where(cut), f"part {k}")
    return spark.createDataFrame([(root,)], "root string")


@query("committed_records", _RECORDS + """, held AS (SELECT doc_id, count(*) AS n, string_agg(sha256(content), ',' ORDER BY kind) AS hashes FROM files GROUP BY doc_id)
SELECT risk_level, count(*) AS records, CAST(sum(n) AS BIGINT) AS files, count(*) AS entries, CAST(sum(risk_score) AS BIGINT) AS total_score, min(sha256(full_result)) AS least_fingerprint, max(hashes) AS most_hashes, true AS sound FROM rec JOIN held USING (doc_id) GROUP BY risk_level""")
def committed_records(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the store sees, by level: records with their files, and with the ledger entries that name their fingerprint."""
    root = stored(spark, d).first()["root"]
    of = lambda name: commits.committed(spark, root, name)
    files = of("files").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "sha256"))), lambda x: x["sha256"]), ",").alias("hashes"))
    entry = of("transactions").select(F.col("subject_id").cast("long").alias("doc_id"), "payload.result_sha256", F.lit(1).alias("entry"))
    rows = of("analyses").join(files, "doc_id", "left").join(entry, "doc_id", "left")
    vouched = F.coalesce(F.col("result_sha256") == F.sha2("full_result", 256), F.lit(False))
    sound = ledger.verified(of("blocks"), of("transactions")).first()["ok"]
    by = rows.groupBy("risk_level").agg(
        F.count("*").alias("records"), F.sum("n").alias("files"), F.count_if(vouched).alias("entries"), F.sum("risk_score").alias("total_score"), F.min("fingerprint").alias("least_fingerprint"), F.max("hashes").alias("most_hashes"),
    )
    return by.withColumn("sound", F.lit(sound))


@query("chain_payloads", _RECORDS + """, ev AS (SELECT doc_id, string_agg('{"kind":"' || kind || '","sha256":"' || sha256(content) || '"}', ',' ORDER BY kind) AS evidence FROM files GROUP BY doc_id)
SELECT doc_id, sha256('{"action":"screening.created","actor":null,"payload":{"evidence":[' || evidence || '],"recommendation":"' || recommendation || '","result_sha256":"' || sha256(full_result) || '","risk_level":"' || risk_level || '","risk_score":' || risk_score
  || '},"subject_id":"' || doc_id || '","subject_type":"analysis","timestamp":"2024-06-01T00:00:00","tx_index":' || doc_id % 25 || '}') AS hash FROM rec JOIN ev USING (doc_id)""")
def chain_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each screening's ledger entry: fingerprint of the result, hashes of the files, outcome."""
    return screening_transactions(records(spark, d), evidence_files(spark, d), 1).select(F.col("subject_id").cast("long").alias("doc_id"), "hash")


@query("mined_next_block", r._CHAIN + """, top AS (SELECT i + 1 AS i, hash, merkle, timestamp FROM c ORDER BY i DESC LIMIT 1),
hit AS (SELECT i, n, sha256('{"difficulty":3,"index":' || i || ',"merkle_root":"' || merkle || '","nonce":' || n || ',"prev_hash":"' || hash || '","timestamp":"' || timestamp || '"}') AS h FROM top, (SELECT unnest(range(0, 100000)) AS n))
SELECT i AS block_index, min(n) AS nonce, min_by(h, n) AS hash FROM hit WHERE starts_with(h, '000') GROUP BY i""")
def mined_next_block(spark: SparkSession, d: str) -> DataFrame:
    """The block after the chain's head, with the last block's entries, at three zeros: all tasks look for its nonce."""
    head = r.chain(spark, d).agg(F.max_by(F.struct("block_index", "hash", "merkle", "timestamp"), "block_index").alias("h")).first()["h"]  # one block
    nonce, digest = ledger.mined(spark, head["block_index"] + 1, head["timestamp"], head["hash"], head["merkle"], 3)
    return spark.createDataFrame([(head["block_index"] + 1, nonce, digest)], "block_index long, nonce long, hash string")


# Rules by type of document --------------------------------------------------------------------------
#: An identity card needs no zone and no date of issue, and the passport's own rules don't apply.
CATALOGUE = rules.CATALOGUE | {"identity_card": rules.RuleSet(rules.COMMON, tuple(f for f in rules.REQUIRED if f != "issue_date"))}
_TYPE = "['passport', 'identity_card', 'visa', 'identity_card', NULL][doc_id % 5 + 1]"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("passport", "identity_card", "visa", "identity_card", None))), (F.col("doc_id") % 5 + 1).cast("int"))
    return r.documents(spark, d).withColumn("type", kind)


@query("rules_by_type", r._FOUND + f"""SELECT doc_id, type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, rule_id, field, status, severity FROM (SELECT *, {_TYPE} AS type FROM f)
WHERE coalesce(type, '') <> 'identity_card' OR (category <> 'passport' AND rule_id NOT IN ('REQUIRED_MRZ', 'REQUIRED_ISSUE_DATE'))""")
def rules_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Findings of documents of several types, from a catalogue that is read as a table; unknown types and none fall back."""
    rows = _typed(spark, d)
    held = rules.read_catalogue(rules.catalogue_table(spark, CATALOGUE))
    return rules.findings(rows, held).join(rows.select("doc_id", "type"), "doc_id").select("doc_id", "type", "pos", "rule_id", "field", "status", "severity")


# Uploads --------------------------------------------------------------------------------------------
_PNG = "89504E470D0A1A0A0000000D49484452000000640000004B"
_BYTES = f"CASE doc_id % 6 WHEN 0 THEN '{_PNG}' || hex(encode(text)) WHEN 1 THEN 'FFD8FFE0' || hex(encode(text)) WHEN 2 THEN '{_PNG}' WHEN 3 THEN '{_PNG[:40]}' ELSE hex(encode(text)) END"


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Texts as uploaded files: with the header of a PNG or JPEG file before them, one that is cut, or none."""
    k = F.col("doc_id")
    declared = F.element_at(F.array(*map(F.lit, ("image/png", "IMAGE/JPEG", "image/webp", None, "image/jpg"))), (k % 5 + 1).cast("int"))
    head = F.when(k % 6 == 0, _PNG).when(k % 6 == 1, "FFD8FFE0").when(k % 6 == 2, _PNG).when(k % 6 == 3, _PNG[:40])
    body = F.when((k % 6).isin(2, 3), F.lit(b"")).otherwise(F.encode(F.col("text"), "UTF-8"))
    content = F.when(head.isNull(), body).otherwise(F.concat(F.unhex(head), body))
    return table(spark, d, "documents").select(k.cast("string").alias("path"), declared.alias("media_type"), content.alias("content"))


@query("upload_routes", f"""WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS path, ['image/png', 'IMAGE/JPEG', 'image/webp', NULL, 'image/jpg'][doc_id % 5 + 1] AS media_type, {_BYTES} AS x FROM documents),
k AS (SELECT path, replace(lower(media_type), 'image/jpg', 'image/jpeg') AS said, lower(media_type) AS raw, CAST(coalesce(length(x) // 2, 0) AS INTEGER) AS length, CASE WHEN starts_with(x, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(x, 'FFD8FF') THEN 'image/jpeg' END AS kind FROM u),
j AS (SELECT *, CASE WHEN said NOT IN ('image/jpeg', 'image/png') THEN '415 type not allowed' WHEN length > 3000 THEN '413 too large' WHEN length = 0 THEN '422 empty' WHEN kind IS NULL THEN '422 no known image' WHEN said <> kind THEN '422 not of the declared type'
  WHEN kind = 'image/png' AND length < 24 THEN '422 broken header' END AS fault FROM k)
SELECT path, fault IS NULL AS taken, length, CAST(left(fault, 3) AS INTEGER) AS status, substr(fault, 5) AS reason FROM j""")
def upload_routes(spark: SparkSession, d: str) -> DataFrame:
    """Accepted files and rejects of a batch, which is read once."""
    taken, rejects = store.routed_uploads(_uploads(spark, d), most=3000)
    one = taken.select("path", F.lit(True).alias("taken"), "length", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("reason"))
    return one.unionByName(rejects.select("path", F.lit(False).alias("taken"), "length", "status", "reason"))


@query("face_quality_score", """SELECT c_custkey AS doc_id, least(CASE WHEN c_custkey % 10 >= 6.5 THEN 2 WHEN c_custkey % 10 >= 5 THEN 1 ELSE 0 END, CASE WHEN c_custkey % 97 >= 80 THEN 2 WHEN c_custkey % 97 >= 45 THEN 1 ELSE 0 END,
  CASE WHEN c_custkey % 150 >= 120 THEN 2 WHEN c_custkey % 150 >= 40 THEN 1 ELSE 0 END) / 2.0::DOUBLE AS score FROM customer""")
def face_quality_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("doc_id"), signals.quality_score(signals.quality_grade(k % 10 / 10, k % 97, k % 150)).alias("score"))
