"""Specimen cases of the screening operators, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import hashlib
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vellum.functions import dates, measures, mrz
from vellum.operators import fusion, ledger, rules, signals, text
from vellum.plans import registry
from vellum.sources import store


def plain(frame):
    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, (datetime.datetime, datetime.date)):
            return str(x)[:19] if getattr(x, "hour", 0) else str(x)[:10]
        return x if isinstance(x, (str, bool)) else round(float(x), 6)

    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(one(x) for x in row)) for row in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(db.sql(registry.oracle_sql()[name]).df())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("data,digit", [("L898902C3", "6"), ("D23145890734", "9"), ("340712", "7"), ("<<<", "0")])
def test_check_digit(spark, data, digit):
    assert value(spark, mrz.check_digit(F.lit(data))) == digit


def test_specimen_zone(spark):
    rows = spark.createDataFrame([("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"), (None, None)], "line1 string, line2 string")
    first, none = mrz.with_mrz(rows).collect()
    assert (first.surname, first.given, first.mrz_number, first.mrz_nationality, first.reliable) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "UTO", True)
    assert all(first[f"ok_{c}"] for c in ("number", "dob", "expiry", "optional", "composite"))
    assert not none.has_mrz and not none.reliable


@pytest.mark.parametrize("raw,day", [("12 APR 1998", "1998-04-12"), ("12/04/1998", "1998-04-12"), ("12.4.98", "1998-04-12"), ("1998-04-12", "1998-04-12"), ("01/02/30", "2030-02-01"), ("32 APR 1998", None), ("1998-13-01", None), ("", None), ("words", None)])
def test_printed_date(spark, raw, day):
    found = value(spark, dates.parse_date(F.lit(raw)))
    assert (found and str(found)) == day


@pytest.mark.parametrize("raw,expiry,day", [("740812", False, "1974-08-12"), ("120415", True, "2012-04-15"), ("300101", True, "2030-01-01"), ("99AB99", False, None)])
def test_zone_date(spark, raw, expiry, day):
    found = value(spark, dates.parse_mrz_date(F.lit(raw), F.lit("2024-06-01").cast("date"), expiry))
    assert (found and str(found)) == day


def test_measures(spark):
    box = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, measures.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, measures.iou(F.lit(None).cast("array<int>"), box(0, 0, 1, 1))) == 0
    point = lambda k: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (i == k).cast("double"))
    assert value(spark, measures.wasserstein1(point(30), point(80))) == pytest.approx(50)
    assert value(spark, measures.chi_square(point(30), point(30))) == 0
    assert value(spark, measures.cosine(box(0.0, 0.0), box(1.0, 2.0))) == 0


def scenario(spark, rows):
    schema = "doc_id long, pos int, id string, source string, finding_type string, polarity string, severity string, confidence double, field string, region array<int>, message string"
    items = spark.createDataFrame(rows, schema)
    return fusion.risk(items, fusion.pairs(items)).first()


def item(pos, source, polarity, severity, confidence=1.0, field=None, region=None):
    return (1, pos, f"{source}:{pos}", source, "x", polarity, severity, confidence, field, region, f"told {pos}")


@pytest.mark.parametrize(
    "rows,score,level,action",
    [
        ([item(0, "rules", "REASSURING", "INFO")], 0, "LOW", "NO_ADDITIONAL_ACTION"),
        ([item(0, "rules", "CONCERN", "HIGH", field="date_of_birth")], 25, "MEDIUM", "MANUAL_REVIEW"),
        ([item(0, "rules", "CONCERN", "HIGH", 1.0, "date_of_birth", [100, 300, 400, 340]), item(1, "forensics", "CONCERN", "HIGH", 0.85, "photo", [110, 305, 390, 338])], 65, "HIGH", "ESCALATE"),
        ([item(0, "biometrics", "CONCERN", "CRITICAL", 0.95, "identity")], 39, "HIGH", "ENHANCED_VERIFICATION"),
        ([item(0, "forensics", "CONCERN", "MEDIUM", 0.8, "photo"), item(1, "biometrics", "REASSURING", "INFO", 0.95, "photo")], 9, "LOW", "MANUAL_REVIEW"),
    ],
)
def test_worked_scores(spark, rows, score, level, action):
    found = scenario(spark, rows)
    assert (found.score, found.level, found.action) == (score, level, action)


def test_merkle_root(spark):
    def root(leaves):
        while len(leaves) > 1:
            leaves = [hashlib.sha256((leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).encode()).hexdigest() for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 2, 3, 7, 8, 25):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        held = F.array(*map(F.lit, leaves)) if n else F.array().cast("array<string>")
        assert value(spark, ledger.merkle_root(held)) == root(leaves)


def ledger_of(spark, difficulty=0):
    rows = [("SCREENING", "clerk" if i % 2 else None, (f"L{i}", i), str(i), "analysis", f"2024-01-{1 + i // 4:02d}T00:00:00", i % 4, 1 + i // 4) for i in range(22)]
    tx = spark.createDataFrame(rows, "action string, actor string, payload struct<risk_level:string,risk_score:long>, subject_id string, subject_type string, timestamp string, tx_index int, block_index long")
    tx = ledger.with_hash(tx).cache()
    return tx, ledger.sealed(ledger.blocks(tx), difficulty=difficulty).cache()


def test_ledger_reports_the_first_broken_block(spark):
    tx, chain = ledger_of(spark)
    sound = ledger.verified(chain, tx).first()
    assert (sound.ok, sound.blocks, sound.transactions, sound.broken_at, sound.reason) == (True, 7, 22, None, None)
    change = lambda c, i, x: chain.withColumn(c, F.when(F.col("block_index") == i, F.lit(x)).otherwise(F.col(c)))
    swapped = chain.withColumn("block_index", F.when(F.col("block_index") == 3, 4).when(F.col("block_index") == 4, 3).otherwise(F.col("block_index")))
    cases = {
        (5, "index"): (chain.where("block_index <> 4"), tx),
        (1, "index"): (chain.where("block_index <> 0"), tx),
        (3, "link"): (swapped, tx),
        (2, "transaction"): (chain, ledger.tampered(tx, 2)),
        (4, "merkle"): (change("merkle", 4, "0" * 64), tx),
        (6, "merkle"): (chain, tx.where("not (block_index = 6 and tx_index = 0)")),
        (5, "hash"): (change("timestamp", 5, "1900-01-01T00:00:00"), tx),
        (6, "hash"): (change("nonce", 6, 9), tx),
    }
    for (at, why), (blocks, held) in cases.items():
        found = ledger.verified(blocks, held).first()
        assert (found.ok, found.broken_at, found.reason) == (False, at, why), (at, why, found)
    both = ledger.verified(change("timestamp", 5, "x"), ledger.tampered(tx, 3)).first()
    assert (both.broken_at, both.reason) == (3, "transaction")
    healed = ledger.restored(ledger.tampered(tx, 2), tx.where("block_index = 2"))
    assert ledger.verified(chain, healed).first().ok
    none = ledger.verified(chain.where("false"), tx.where("false")).first()
    assert none.ok and none.head is None and none.blocks == 0


def test_ledger_work_and_append(spark):
    tx, chain = ledger_of(spark, difficulty=2)
    assert ledger.verified(chain, tx).first().ok and all(r.hash.startswith("00") for r in chain.collect())
    lazy = ledger_of(spark)[1].withColumn("difficulty", F.lit(1)).where("block_index = 0")
    assert ledger.verified(lazy, tx.where("false")).first().reason == "hash"
    rows = ledger.blocks(tx).cache()
    first = ledger.sealed(rows.where("block_index <= 3"))
    head = first.orderBy(F.desc("block_index")).first()
    more = ledger.sealed(rows.where("block_index > 3"), (head.block_index, head.hash))
    assert sorted(first.unionByName(more).collect()) == sorted(ledger.sealed(rows).collect())
    gaps = spark.createDataFrame([(k,) for k in (5, 7, 7, 200_000, 3_000_000)], "k long")
    assert sorted((r.k, r.n) for r in ledger.numbered(gaps, "k", "n", first=1).collect()) == [(5, 1), (7, 2), (7, 2), (200_000, 3), (3_000_000, 4)]
    content = spark.createDataFrame([(1, None, ("é", None))], "b int, a string, c struct<z:string,y:int>")
    assert content.select(ledger.canonical(content, "a", "b", "c").alias("j")).first().j == '{"a":null,"b":1,"c":{"y":null,"z":"é"}}'


def page_of(spark, *pages):
    """Lines of documents 0, 1, ...: (text, x, y), 30 high and 12 wide a character."""
    return spark.createDataFrame([(d, i, t, 0.95, x, y, x + 12 * len(t), y + 30) for d, rows in enumerate(pages) for i, (t, x, y) in enumerate(rows)], "doc_id long, line_pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


DATED = [
    ([("Date of birth 12 APR 1998", 100, 100)], {"date_of_birth": "12 APR 1998"}),
    ([("Date of issue", 100, 100), ("12 APR 2018", 100, 140), ("Date of expiry", 400, 100), ("11 APR 2028", 400, 140)], {"issue_date": "12 APR 2018", "expiry_date": "11 APR 2028"}),
    ([("Date of birth", 100, 100), ("12/04/1998", 400, 105)], {"date_of_birth": "12/04/1998"}),
    ([("12 APR 1998", 100, 20), ("Date of birth", 100, 100)], {}),
    ([("Date of birth", 100, 100), ("12 APR 1998", 100, 300)], {}),
    ([("Birth and issue 2018-01-02", 100, 100), ("2019-03-04", 100, 140)], {"date_of_birth": "2018-01-02", "issue_date": "2019-03-04"}),
    ([("Valid until 1-2-30", 100, 100), ("issued 12 APRIL 2018", 100, 200)], {"expiry_date": "1-2-30"}),
]


def test_dates_go_to_their_labels(spark):
    found = [{} for _ in DATED]
    for r in text.labelled_dates(page_of(spark, *(rows for rows, _ in DATED))).collect():
        found[r.doc_id][r.field] = r.value
    assert found == [want for _, want in DATED]


NAMED = [("SURNAME: ERIKSSON", "ERIKSSON"), ("Surname / Nom ERIKSSON", "ERIKSSON"), ("Name - ANNA MARIA", "ANNA MARIA"), ("Surname", None), ("Surname Eriksson", None), ("first name ANNA", None), ("SURNAME ERIKSSON", "SURNAME ERIKSSON")]


def test_names(spark):
    found = {r.doc_id: r.value for r in text.labelled_texts(page_of(spark, *([(line, 0, 0)] for line, _ in NAMED))).where("field = 'name'").collect()}
    assert [found.get(i) for i in range(len(NAMED))] == [name for _, name in NAMED]


L1, L2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
SERIAL = "SERIAL0123456789012345678"


ZONES = [
    ([L1, L2], (L1, L2)), ([L1, L2, SERIAL], (L1, L2)), ([L1 + L2], (L1, L2)), ([L1 + L2, SERIAL], (L1 + L2, SERIAL)), ([SERIAL], (SERIAL, None)),
    ([f"{L1[:20]} {L1[20:]}".lower(), L2], (L1, L2)), ([SERIAL, L1, SERIAL + "X"], (L1, SERIAL + "X")), (["P<UTO PASSPORT"], None),
]


def test_zone_lines(spark):
    page = page_of(spark, *([(t, 10, 900 + 40 * i) for i, t in enumerate(rows)] for rows, _ in ZONES))
    found = {r.doc_id: r for r in text.mrz_pair(text.mrz_candidates(page)).collect()}
    assert [(found[i].line1, found[i].line2) if i in found else None for i in range(len(ZONES))] == [want for _, want in ZONES]
    assert found[0].zone_box == [10, 900, 10 + 12 * 44, 970]


def test_fields_fall_back_to_the_zone(spark):
    page = page_of(spark, [("PASSPORT NO L898902", 0, 0), ("Date of birth 12 AUG 1974", 0, 50), (L1, 0, 900), (L2, 0, 940)])
    zone = mrz.with_mrz(text.mrz_pair(text.mrz_candidates(page)))
    found = {r.field: (r.value, r.source, r.confidence) for r in text.fields(page, zone).collect()}
    assert found == {
        "document_number": ("L898902", "visual", 0.95), "date_of_birth": ("12 AUG 1974", "visual", 0.95), "nationality": ("UTO", "mrz", 0.9),
        "name": ("ANNA MARIA ERIKSSON", "mrz", 0.9), "expiry_date": ("120415", "mrz", 0.9),
    }
    kinds = [text.classified(p, text.mrz_pair(text.mrz_candidates(p))).first().confidence for p in (page, page.where("line_pos < 2"), page.where("line_pos = 1"))]
    assert kinds == [0.98, 0.85, 0.40]


def test_recognised_words(spark):
    raw = [(1, 0, 1, 0, 0, "one", 90, 5, 5, 10, 10), (1, 1, 0, 0, 0, " two ", 250, 0, 0, 10, 10), (1, 2, 1, 0, 0, " ", 90, 0, 0, 1, 1), (1, 3, 1, 0, 0, "gone", -1, 0, 0, 1, 1), (1, 4, 1, 0, 0, "three", 0, 0, 0, 1, 1)]
    found = text.recognised_words(spark.createDataFrame(raw, "doc_id long, seq int, block int, par int, line int, text string, conf int, x int, y int, w int, h int"))
    assert sorted((r.line_id, r.text, r.confidence, r.x2) for r in found.collect()) == [(0, "one", 0.9, 15), (0, "three", 0.0, 1), (1, "two", 1.0, 10)]


GOOD = {
    "document_number": "L898902C3", "number_source": "visual", "nationality": "UTO", "nationality_source": "visual", "name": "ANNA MARIA ERIKSSON", "name_source": "visual", "date_of_birth": "12 AUG 1974", "dob_source": "visual",
    "issue_date": "15 APR 2002", "issue_source": "visual", "expiry_date": "15 APR 2012", "expiry_source": "visual", "line1": L1, "line2": L2,
}


def judged(spark, *changes):
    """The findings of the sound document and of changed ones, in one run."""
    rows = [(i, *{**GOOD, **c}.values()) for i, c in enumerate(changes)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", *(f"{k} string" for k in GOOD)]))
    found = [[] for _ in changes]
    for r in rules.findings(rules.prepared(docs, "2010-01-01")).orderBy("doc_id", "pos").collect():
        found[r.doc_id].append((r.rule_id, r.status, r.severity))
    return found


CHANGED = [
    ({"name": "ERIKSSON"}, ("CONSISTENCY_NAME", "PASS", "INFO")),
    ({"name": "ANNA ANNA ERIKSSON"}, ("CONSISTENCY_NAME", "FAIL", "HIGH")),
    ({"name": "ANNA-MARIA ERIKSSON"}, ("CONSISTENCY_NAME", "FAIL", "HIGH")),
    ({"name_source": "mrz"}, ("CONSISTENCY_NAME", "NOT_APPLICABLE", "INFO")),
    ({"document_number": "L898902"}, ("CONSISTENCY_DOCUMENT_NUMBER", "WARNING", "LOW")),
    ({"document_number": "--"}, ("CONSISTENCY_DOCUMENT_NUMBER", "FAIL", "HIGH")),
    ({"document_number": "l 898902-c3"}, ("CONSISTENCY_DOCUMENT_NUMBER", "PASS", "INFO")),
    ({"number_source": "mrz"}, ("CONSISTENCY_DOCUMENT_NUMBER", "NOT_APPLICABLE", "INFO")),
    ({"nationality": "u-t-o"}, ("CONSISTENCY_NATIONALITY", "PASS", "INFO")),
    ({"nationality_source": "mrz"}, ("CONSISTENCY_NATIONALITY", "NOT_APPLICABLE", "INFO")),
    ({"expiry_date": "16 APR 2012"}, ("CONSISTENCY_EXPIRY", "FAIL", "HIGH")),
    ({"expiry_date": "soon"}, ("CONSISTENCY_EXPIRY", "FAIL", "MEDIUM")),
    ({"expiry_date": "120415", "expiry_source": "mrz"}, ("CONSISTENCY_EXPIRY", "NOT_APPLICABLE", "INFO")),
    ({"expiry_date": "120415", "expiry_source": "mrz"}, ("DATE_VALID_EXPIRY_DATE", "PASS", "INFO")),
    ({"issue_date": "16 APR 2012"}, ("DATE_ISSUE_BEFORE_EXPIRY", "FAIL", "HIGH")),
    ({"line1": None, "line2": None}, ("CONSISTENCY_MRZ", "NOT_APPLICABLE", "INFO")),
    ({"line2": L2[1:] + "<"}, ("MRZ_UNRELIABLE", "WARNING", "MEDIUM")),
    ({"date_of_birth": None}, ("REQUIRED_DATE_OF_BIRTH", "FAIL", "MEDIUM")),
]


def test_rules_on_changed_documents(spark):
    sound, *found = judged(spark, {}, *(c for c, _ in CHANGED))
    assert len(sound) == 30 and all(x[1:] == ("PASS", "INFO") for x in sound)
    assert [x[0] for x in sound if x[0].startswith("CONSISTENCY")] == [f"CONSISTENCY_{c}" for c in ("NAME", "DOB", "DOCUMENT_NUMBER", "NATIONALITY", "EXPIRY")]
    for (change, want), own in zip(CHANGED, found):
        assert want in own, change


def test_correlations_of_all_kinds(spark):
    schema = "doc_id long, pos int, id string, source string, finding_type string, polarity string, severity string, confidence double, field string, region array<int>, message string"
    kinds = lambda rows: [(r.type, r.field, r.ids) for r in (lambda i: fusion.correlations(i, fusion.pairs(i)))(spark.createDataFrame(rows, schema)).orderBy("pos").collect()]
    face = item(9, "biometrics", "CONCERN", "CRITICAL", 0.95, "identity")
    calm = [item(0, "rules", "REASSURING", "INFO"), item(5, "forensics", "REASSURING", "INFO")]
    assert kinds(calm) == [("CONSISTENCY", None, ["rules:0", "forensics:5"])]
    assert kinds([*calm, face]) == [("CONTRADICTION", "identity", ["biometrics:9"])]
    assert kinds([item(0, "rules", "CONCERN", "LOW", field="name"), face]) == []
    both = [item(0, "rules", "CONCERN", "HIGH", 1.0, "photo", [100, 300, 400, 340]), item(1, "forensics", "CONCERN", "HIGH", 0.85, "photo", [110, 305, 390, 338]), item(2, "biometrics", "REASSURING", "INFO", 0.95, "photo")]
    assert kinds(both) == [("CORROBORATION", "photo", ["rules:0", "forensics:1"]), ("CONTRADICTION", "photo", ["rules:0", "biometrics:2"]), ("CONTRADICTION", "photo", ["forensics:1", "biometrics:2"])]
    items = spark.createDataFrame(both, schema)
    linked = fusion.pairs(items)
    told = fusion.explained(items, fusion.correlations(items, linked), fusion.risk(items, linked)).first()
    assert told.primary_concern == "[rules] told 0" and told.based_on == ["rules:0", "forensics:1", "rules:0+forensics:1"] and told.targets == ["rules:0", "forensics:1"]
    assert told.reasons == ["[rules] told 0", "[forensics] told 1", "several engines agree on a concern", "without evidence of biometrics"]
    assert told.reasoning[1] == "forensics: x at photo, HIGH, confidence 0.85, 18.5 points" and len(told.reasoning) == 7
    assert told.corroborating == ["rules and forensics both point at photo"] and told.counter[0] == "rules doubts photo, biometrics doesn't: the doubt stays" and told.counter[-1] == "[biometrics] told 2"
    assert [(p.source, p.field, p.note) for p in told.locations] == [("rules", "photo", "told 0"), ("forensics", "photo", "told 1")] and told.overall.startswith("HIGH priority")


def test_a_zone_of_one_line_and_blank_dates(spark):
    """One line is no zone whose type counts, and a date that the zone leaves blank is missing, not invalid."""
    page = spark.createDataFrame([(1, 0, "some words"), (2, 0, "some words")], "doc_id long, line_pos int, text string")
    zones = spark.createDataFrame([(1, "P<UTO", None), (2, "P<UTO", "L898902C36UTO")], "doc_id long, line1 string, line2 string")
    assert {r.doc_id: r.confidence for r in text.classified(page, zones).collect()} == {1: 0.4, 2: 0.85}
    line2 = "L898902C36UTO" + "<" * 7 + "F" + "<" * 7 + "ZE184226B<<<<<10"
    zone = mrz.with_mrz(spark.createDataFrame([(1, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", line2, [0, 0, 1, 1])], "doc_id long, line1 string, line2 string, zone_box array<int>"))
    lines = spark.createDataFrame([(1, 0, "words", 0.9, 0, 0, 9, 9)], "doc_id long, line_pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    found = {r.field for r in text.fields(lines, zone).collect()}
    assert "document_number" in found and not found & {"date_of_birth", "expiry_date"}


def test_missing_layers_and_errors_are_neutral(spark):
    layers = spark.createDataFrame([(1, 1, "a", "calibration_missing", False, "high", 0.5, None, "ok"), (1, 2, "b", "normal", False, "high", 0.5, None, "ok"), (1, 3, "c", "x_anomaly", False, "odd", 0.5, [1, 2, 3, 4], "ok")], "doc_id long, layer int, layer_name string, finding_type string, passed boolean, severity string, confidence double, region array<int>, status string")
    found = fusion.forensic_items(layers, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert sorted((r.doc_id, r.id, r.polarity, r.severity, r.field) for r in found.collect()) == [(1, "forensics:a", "NEUTRAL", "INFO", None), (1, "forensics:b", "REASSURING", "INFO", None), (1, "forensics:c", "CONCERN", "MEDIUM", "photo"), (2, "forensics:unavailable", "NEUTRAL", "INFO", None)]


def test_every_value_counts_in_a_histogram(spark):
    rows = spark.createDataFrame([("a", x) for x in (-5.0, 0.0, 250.0, 500.0, 900.0, float("nan"), None)], "k string, v double")
    assert sorted((r.bin, r.share) for r in signals.histogram(rows, "k", "v", 0.0, 500.0).collect()) == [(0, 0.4), (128, 0.2), (255, 0.4)]


def test_percentile_and_mahalanobis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + 3
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    for q in (0.0, 0.33, 0.95, 1.0):
        assert signals.percentile(rows, "a", q) == pytest.approx(np.percentile(x[:, 0], 100 * q))
    assert signals.percentile(rows.where("false"), "a", 0.5) is None
    inverse = np.linalg.pinv(np.cov(x, rowvar=False) + 1e-6 * np.eye(3))
    far = [float(np.sqrt(d @ inverse @ d)) for d in x - x.mean(axis=0)]
    mean, found, threshold = signals.colour_baseline(rows, ["a", "b", "c"])
    assert threshold == pytest.approx(np.percentile(far, 95))
    got = {r.i: r.d for r in rows.select("i", signals.mahalanobis(["a", "b", "c"], mean, found).alias("d")).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(far)


def test_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha256 string, n int")
    assert [store.append_new(rows, f"{tmp_path}/files", "sha256") for _ in range(2)] == [2, 0]
    assert store.append_new(spark.createDataFrame([("c", 3), ("a", 9)], rows.schema), f"{tmp_path}/files", "sha256") == 1
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/files").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    store.save_json(rows, f"{tmp_path}/json", "sha256")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    for name in ("b.JPG", "a.png", "c.txt", "d.tif"):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"123")
    assert [(r.name, r.media_type, r.length) for r in store.image_files(spark, f"{tmp_path}/img").collect()] == [("a.png", "image/png", 3), ("b.JPG", "image/jpeg", 3), ("d.tif", "image/tiff", 3)]
    assert [r.name for r in store.image_files(spark, f"{tmp_path}/img").where("media_type = 'image/jpeg'").collect()] == ["b.JPG"]


def test_calibration_is_never_made_anew(spark, tmp_path):
    def made(where, **meta):
        for name in ("intensity", "texture"):
            spark.createDataFrame([([1.0, 2.0],)], "bins array<double>").write.parquet(f"{tmp_path}/{where}/{name}")
        (tmp_path / where / "metadata").mkdir()
        (tmp_path / where / "metadata" / "m.json").write_text(json.dumps(meta))
        return f"{tmp_path}/{where}"

    assert signals.calibration(spark, made("good", algorithm_version="2", artifacts_locked=True), "2").count() == 2
    with pytest.raises(RuntimeError):
        signals.calibration(spark, made("old", algorithm_version="1", artifacts_locked=True), "2")
    with pytest.raises(RuntimeError):
        signals.calibration(spark, made("open", algorithm_version="2", artifacts_locked=False), "2")
    with pytest.raises(FileNotFoundError):
        signals.calibration(spark, f"{tmp_path}/none", "2")


def test_faces(spark):
    faces = spark.createDataFrame([(1, 1, 9.0), (2, 1, 10.0), (2, 2, 5.0), (3, 1, 10.0), (3, 2, 9.0)], "doc_id long, face int, area double")
    found = {r.doc_id: (r.face, r.ambiguous) for r in signals.primary_face(faces).collect()}
    assert found == {1: (1, False), 2: (1, False), 3: (None, True)}
    assert value(spark, signals.quality_grade(F.lit(0.7), F.lit(90), F.lit(50))) == "ACCEPTABLE"


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and rows[0].score == max(r.score for r in rows)
