"""Numbers and JSON as Python has them, commits that fail half-way, calibration that locks, rasters, rules by type, uploads, work."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vellum.functions.numbers import half_even, json_text, python_text
from vellum.operators import calibrate, fusion, ledger, raster, rules, signals, text
from vellum.plans import records, registry
from vellum.sources import commits, store, synth, workload


def numbers():
    rng = random.Random(4)
    fixed = [0.0, -0.0, 1e-05, 9.999e-05, 0.0001, 1e15, 1e16, 1e22, 1e23, 2.5, -2.5, 0.125, 2.675, 1.005, 34.5, 14.5, 1e7, 123456.789, 1.7976931348623157e308, float("nan"), float("inf"), -float("inf")]
    return fixed + [rng.uniform(0, 1) for _ in range(2000)] + [round(rng.uniform(-1000, 1000), rng.randint(0, 6)) for _ in range(4000)] + [k / 200 for k in range(-2000, 2000)] + [k / 1000 + 0.0005 for k in range(2000)]


def test_numbers_are_rounded_and_printed_as_python_does(spark):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").select("x", python_text(F.col("x")).alias("t"), half_even(F.col("x"), 2).alias("two"), half_even(F.col("x")).alias("none")).collect()
    for r in rows:
        assert r.t == json.dumps(r.x)
        if math.isfinite(r.x):
            assert (r.two, r.none) == (round(r.x, 2), float(round(r.x)))


def test_canonical_json_of_nested_records(spark):
    schema = "b double, a struct<z:array<struct<y:double,x:string>>,m:map<string,double>>, n int, t boolean, d date"
    value = {"b": 1e-05, "a": {"z": [{"y": -0.0, "x": 'é "q" \\ \n\t\x01\x1f/'}, {"y": 1e16, "x": None}], "m": {"k": 0.1, "a": 2.0}}, "n": None, "t": True, "d": None}
    row = spark.createDataFrame([(value["b"], ([(-0.0, value["a"]["z"][0]["x"]), (1e16, None)], value["a"]["m"]), None, True, None)], schema)
    want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    whole = F.struct(*row.columns)
    assert row.select(json_text(whole, row.select(whole.alias("w")).schema["w"].dataType)).first()[0] == want
    got = row.select(ledger.canonical(row, "b", "a", "n", "t", "d").alias("c"), ledger.fingerprint(row, "b", "a", "n", "t", "d").alias("f")).first()
    assert got.c == want and got.f == hashlib.sha256(want.encode()).hexdigest()


def test_risk_is_folded_in_order_and_ties_are_rounded_to_even(spark):
    rng = random.Random(9)
    items, pairs, want = [], [], {}
    for doc in range(300):
        total, bonus, raw = 0.0, 0.0, {}
        for pos in range(rng.randint(1, 12)):
            source, severity, sure = rng.choice(list(fusion.RELIABILITY)), rng.choice(list(fusion.POINTS)), rng.choice([0.0, 0.1, 0.25, 0.333, 0.6, 0.7, 0.9, 1.0])
            raw[pos] = fusion.POINTS[severity] * fusion.RELIABILITY[source] * (0.5 + 0.5 * sure)
            total += round(raw[pos], 2)
            items.append((doc, pos, f"i{pos}", source, "t", "CONCERN", severity, sure, None, None, "m"))
        for a, b in sorted({tuple(sorted(rng.sample(list(raw), 2))) for _ in range(3)} if len(raw) > 1 else []):
            bonus += 0.5 * sum([raw[a], raw[b]])
            pairs.append((doc, "CORROBORATION", None, f"i{a}", f"i{b}", "x", "y", a, b))
        bonus = round(bonus, 2)
        want[doc] = (int(min(100, round(total + bonus))), bonus)
    shape = "doc_id long, pos int, id string, source string, finding_type string, polarity string, severity string, confidence double, field string, region array<int>, message string"
    rows = spark.createDataFrame(items, shape).repartition(5, "id")
    linked = spark.createDataFrame(pairs, "doc_id long, type string, field string, id_a string, id_b string, source_a string, source_b string, pos_a int, pos_b int")
    assert {r.doc_id: (r.score, r.bonus) for r in fusion.risk(rows, linked).collect()} == want
    ties = [(k, 0, "a", "rules", "t", "CONCERN", "LOW", c, None, None, "m") for k, c in enumerate((0.8, 0.4, 0.0))]  # 4.5, 3.5, 2.5
    assert [r.score for r in fusion.risk(spark.createDataFrame(ties, shape), linked.limit(0)).orderBy("doc_id").collect()] == [4, 4, 2]


# Commits ---------------------------------------------------------------------------------------------
def test_tables_of_a_commit_appear_together_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = lambda n: {"a": spark.range(n).toDF("x"), "b": spark.range(2 * n).toDF("y")}
    assert commits.versions(spark, root) == []
    with pytest.raises(KeyError):
        commits.committed(spark, root, "a")
    assert commits.commit(spark, root, one(3), "first") == 1

    class Died(Exception):
        pass

    def die():
        raise Died

    with pytest.raises(Died):
        commits.commit(spark, root, one(5), "second", before_publish=die)

    class Half:
        """A table whose write fails, after the one before it was staged."""

        write = property(lambda self: die())

    with pytest.raises(Died):
        commits.commit(spark, root, {"a": spark.range(9).toDF("x"), "b": Half()}, "third")
    count = lambda name, v=None: commits.committed(spark, root, name, v).count()
    assert (count("a"), count("b"), len(commits.abandoned(spark, root))) == (3, 6, 2)
    assert commits.commit(spark, root, one(5), "second") == 2 and commits.commit(spark, root, one(5), "second") == 2
    assert (count("a"), count("b"), count("a", 1)) == (8, 16, 3)


def test_of_two_writers_after_the_same_version_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = {"a": spark.range(2).toDF("x")}
    commits.commit(spark, root, rows, "1")
    other = lambda: commits.commit(spark, root, rows, "other")
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, rows, "mine", after=1, before_publish=other)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, rows, "mine", after=1)
    assert [v["token"] for v in commits.versions(spark, root)] == ["1", "other"]
    assert commits.commit(spark, root, rows, "last", before_publish=lambda: commits.commit(spark, root, rows, "between")) == 4


def test_screenings_and_their_blocks_are_one_commit(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows, files = records.records(spark, SF), records.evidence_files(spark, SF)
    records.commit_screenings(spark, root, rows.where("doc_id < 50"), files.where("doc_id < 50"), "low")

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        records.commit_screenings(spark, root, rows.where("doc_id >= 50"), files.where("doc_id >= 50"), "high", before_publish=die)
    of = lambda name: commits.committed(spark, root, name)
    assert of("analyses").count() == of("transactions").count() == rows.where("doc_id < 50").count()
    records.commit_screenings(spark, root, rows.where("doc_id >= 50"), files.where("doc_id >= 50"), "high")
    assert of("analyses").count() == of("transactions").count() == rows.count() and of("files").count() == files.count()
    assert ledger.verified(of("blocks"), of("transactions")).first()["ok"]
    full = json.loads(of("analyses").where("doc_id = 7").first()["full_result"])
    assert full["doc_id"] == 7 and {"risk", "evidence", "explanation"} <= set(full)


# Kept tables -----------------------------------------------------------------------------------------
def test_kept_tables_follow_their_source(spark, tmp_path):
    d = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{d}/t.parquet")
    build = lambda: spark.read.parquet(f"{d}/t.parquet")
    assert store.kept(spark, d, "rows", build).count() == 3
    first = store.kept(spark, d, "rows", build).inputFiles()
    assert first == store.kept(spark, d, "rows", build).inputFiles()
    spark.range(9).write.mode("overwrite").parquet(f"{d}/t.parquet")
    assert store.kept(spark, d, "rows", build).count() == 9
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store._KEPT[spark.sparkContext.applicationId, d, "rows"][1])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    assert store.kept(spark, d, "rows", build).count() == 9


def test_append_new_and_json_by_value(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert store.append_new(rows, path, "k") == 2 and store.append_new(rows, path, "k") == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    for k in (1, 2):
        store.save_json(rows.where(F.col("k") == k), str(tmp_path / "j"), "k")
    assert spark.read.json(str(tmp_path / "j")).count() == 3


# Rasters ---------------------------------------------------------------------------------------------
def rasters(spark, pictures):
    return spark.createDataFrame([(k, bytearray(p.astype(np.uint8).tobytes()), p.shape[1]) for k, p in enumerate(pictures)], "doc_id long, pixels binary, width int")


def pictures():
    rng = np.random.default_rng(2)
    return [rng.integers(0, 256, (h, w)) for h, w in ((3, 3), (5, 8), (17, 9), (40, 33))] + [np.full((6, 6), 9), np.arange(64).reshape(8, 8) * 4]


def test_texture_codes_and_gradients_pixel_by_pixel(spark):
    rows = rasters(spark, [*pictures(), np.zeros((2, 9))])
    codes = {r.doc_id: r for r in raster.texture_codes(rows).collect()}
    grads = {r.doc_id: r for r in raster.gradients(rows).collect()}
    assert set(codes) == set(grads) == set(range(6))
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    for k, p in enumerate(pictures()):
        h, w = p.shape
        want = np.zeros(256, int)
        for r in range(1, h - 1):
            for c in range(1, w - 1):
                want[sum(1 << b for b, (i, j) in enumerate(around) if p[r + i, c + j] >= p[r, c])] += 1
        assert codes[k].texture == want.tolist() and codes[k].intensity == np.bincount(p.ravel(), minlength=256).tolist()
        at = lambda r, c: int(p[abs(r) if r < h else 2 * h - 2 - r, abs(c) if c < w else 2 * w - 2 - c])  # noqa: B023, E731
        m = []
        for r in range(h):
            for c in range(w):
                x = sum(n * (at(r + i, c + 1) - at(r + i, c - 1)) for i, n in ((-1, 1), (0, 2), (1, 1)))
                y = sum(n * (at(r + 1, c + j) - at(r - 1, c + j)) for j, n in ((-1, 1), (0, 2), (1, 1)))
                m.append(math.hypot(x, y))
        assert grads[k].gradient_mean == pytest.approx(np.mean(m), abs=1e-4) and grads[k].gradient_std == pytest.approx(np.std(m), abs=1e-4)
        assert grads[k].gradient_p95 == pytest.approx(np.percentile(m, 95), abs=1e-4) and grads[k].edge_density == pytest.approx(np.mean(np.array(m) > 30), abs=1e-4)


def test_recompression_by_the_plain_sums(spark):
    got = {r.doc_id: r for r in raster.recompression_errors(rasters(spark, pictures()), 75).collect()}
    steps = [[min(255, max(1, (v * 50 + 50) // 100)) for v in row] for row in raster.LUMINANCE]
    cos = [[math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    scale = lambda u: math.sqrt(1 / 8) if u == 0 else 0.5
    for k in (1, 2, 5):
        p = pictures()[k]
        h, w = p.shape
        errors = np.zeros((h, w), int)
        for top in range(0, h, 8):
            for left in range(0, w, 8):
                b = [[p[min(top + y, h - 1), min(left + x, w - 1)] - 128 for x in range(8)] for y in range(8)]
                f = [[round(scale(u) * scale(v) * sum(b[y][x] * cos[u][y] * cos[v][x] for y in range(8) for x in range(8)) / steps[u][v]) * steps[u][v] for v in range(8)] for u in range(8)]
                for y in range(min(8, h - top)):
                    for x in range(min(8, w - left)):
                        back = sum(scale(u) * scale(v) * f[u][v] * cos[u][y] * cos[v][x] for u in range(8) for v in range(8)) + 128
                        errors[top + y, left + x] = abs(p[top + y, left + x] - min(255, max(0, round(back))))
        r = got[k]
        assert (r.mean_error, r.max_error) == (pytest.approx(errors.mean(), abs=1e-4), errors.max())
        assert (r.std_error, r.p95_error, r.high_error_pct) == (pytest.approx(errors.std(), abs=1e-4), pytest.approx(np.percentile(errors, 95), abs=1e-4), pytest.approx((errors > 10).mean() * 100, abs=1e-4))
    flat = got[4]
    assert flat.max_error <= 1 and signals.compression_decision(raster.recompression_errors(rasters(spark, pictures()), 75), 0.0, 1.0, 0.5).where("doc_id = 4").first()["passed"]


def test_planted_lines_are_found(spark):
    rng = np.random.default_rng(1)
    noise = [(0, int(x), int(y)) for x, y in rng.integers(0, 200, (300, 2))]
    lines = [(0, x, 40) for x in range(20, 160)] + [(0, 90, y) for y in range(10, 150)] + [(0, 30 + t, 50 + t) for t in range(100)]
    broken = [(1, x, 12) for x in [*range(0, 60), *range(90, 160)]] + [(1, x, 12) for x in range(60)]
    rows = spark.createDataFrame(noise + lines + broken, "doc_id long, x int, y int")
    found = raster.straight_edges(rows, 180, 50, 55.0, 10).collect()
    own = {(r.doc_id, r.angle, r.distance): (r.start, r.stop) for r in found if r.doc_id == 0}
    assert {(0, 90, 40), (0, 0, 90), (0, 135, 14)} <= set(own)
    assert own[0, 0, 90][1] - own[0, 0, 90][0] >= 139 and own[0, 90, 40][1] - own[0, 90, 40][0] >= 139
    assert sorted(r.length for r in found if r.doc_id == 1 and (r.angle, r.distance) == (90, 12)) == [59.0, 69.0]
    assert raster.straight_edges(rows.limit(0), 180).collect() == []


def test_edges_of_rasters_are_those_of_their_points_and_shuffle_nothing(spark):
    rng = np.random.default_rng(8)
    made = [np.where(rng.random((30 + k, 40)) < 0.1, 255, 0).astype(np.uint8) for k in range(4)]
    for k, p in enumerate(made):
        p[10 + k] = 255
        p[20:, 5:9] = 128
    rows = rasters(spark, made)
    found = raster.raster_edges(rows, 200.0, 12, 12, 12.0, 4)
    points = raster.edge_points(rows, 200.0)
    want = {tuple(r) for r in raster.straight_edges(points.unionByName(points), 12, 12, 12.0, 4).collect()}
    assert {tuple(r) for r in found.collect()} == want and {r[0] for r in want} == {0, 1, 2, 3}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


# Calibration -----------------------------------------------------------------------------------------
def samples(spark, n):
    rng = np.random.default_rng(6)
    made = [(k, rng.dirichlet(np.ones(256)).tolist(), rng.dirichlet(np.ones(256)).tolist(), float(20 + rng.normal())) for k in range(n)]
    return made, spark.createDataFrame(made, "doc_id long, intensity array<double>, texture array<double>, gradient_mean double")


def test_a_calibration_is_written_once(spark, tmp_path):
    made, rows = samples(spark, 12)
    folder = str(tmp_path / "cal")
    with pytest.raises(ValueError, match="too few"):
        calibrate.calibrated(spark, folder, rows.limit(3))
    spark.range(1).write.parquet(f"{folder}/intensity")  # of a run that failed before the lock
    with pytest.raises(FileNotFoundError):
        calibrate.distances(spark, folder, rows)
    meta = calibrate.calibrated(spark, folder, rows)
    with pytest.raises(calibrate.Locked):
        calibrate.calibrated(spark, folder, rows)
    with pytest.raises(RuntimeError, match="version"):
        calibrate.distances(spark, folder, rows, "2.0")
    i, t, g = (np.array([m[c] for m in made]) for c in (1, 2, 3))
    w1 = lambda a, b: np.abs(np.cumsum(a / a.sum() - b / b.sum())).sum()
    chi = lambda a, b: 0.5 * (((a - b) ** 2) / (a + b + 1e-10)).sum()
    rest = lambda x, k: np.delete(x, k, axis=0).mean(axis=0)
    high = lambda d: np.percentile(d, 99) * 1.5
    limit = meta["thresholds"]
    assert limit["intensity"] == pytest.approx(max(0.45, high([w1(i[k], rest(i, k)) for k in range(12)])), rel=1e-9)
    assert limit["lbp"] == pytest.approx(max(0.1, high([chi(t[k], rest(t, k)) for k in range(12)])), rel=1e-9)
    assert limit["gradient"] == pytest.approx(max(1.5, high([abs(g[k] - rest(g, k)) for k in range(12)])), rel=1e-9)
    far, kept = calibrate.distances(spark, folder, rows)
    assert kept["thresholds"] == limit
    mean = i.mean(axis=0) / i.mean(axis=0).sum()
    assert {r.doc_id: r.d_intensity for r in far.collect()} == pytest.approx({k: w1(i[k], mean) for k in range(12)})


# Rules, uploads, work ----------------------------------------------------------------------------------
def test_rules_follow_the_catalogue(spark):
    held = rules.read_catalogue(rules.catalogue_table(spark, records.CATALOGUE))
    assert held == records.CATALOGUE
    docs = registry.documents(spark, SF).withColumn("type", F.when(F.col("doc_id") % 2 == 0, "identity_card").when(F.col("doc_id") % 3 == 0, "never heard of"))
    got = rules.findings(docs, held)
    plain = rules.findings(registry.documents(spark, SF))
    ids = lambda rows, cond: {(r.doc_id, r.rule_id, r.status) for r in rows.where(cond).collect()}
    assert ids(got, "doc_id % 2 = 1") == ids(plain, "doc_id % 2 = 1")
    assert ids(got, "doc_id % 2 = 0") == ids(plain, "doc_id % 2 = 0 and category <> 'passport' and rule_id not in ('REQUIRED_MRZ', 'REQUIRED_ISSUE_DATE')")
    with pytest.raises(ValueError, match="no rules"):
        rules.read_catalogue(rules.catalogue_table(spark, {"passport": rules.RuleSet(("date", "made_up"), ())}))
    with pytest.raises(ValueError, match="fall back"):
        rules.read_catalogue(rules.catalogue_table(spark, {"card": rules.RuleSet(("date",), ())}))


def test_broken_uploads_are_rejected_and_the_rest_goes_on(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    files = {"good.png": png, "good.jpg": b"\xff\xd8\xff\xe0 jpeg", "cut.png": png[:20], "zero.png": png[:16] + bytes(8), "text.jpg": b"not an image", "swapped.png": b"\xff\xd8\xff\xe0", "empty.png": b"", "note.txt": b"hello", "large.jpg": b"\xff\xd8\xff" + bytes(5000), "noname": png}
    (tmp_path / "deep").mkdir()
    for name, data in files.items():
        (tmp_path / "deep" / name).write_bytes(data)
    taken, rejects = store.routed_uploads(store.uploaded_files(spark, str(tmp_path)), most=4000)
    name = lambda r: r.path.rsplit("/", 1)[-1]
    assert {name(r): (r["kind"], r["size"], bytes(r.content)) for r in taken.collect()} == {"good.png": ("image/png", [640, 480], png), "good.jpg": ("image/jpeg", None, files["good.jpg"]), "noname": ("image/png", [640, 480], png)}
    assert {name(r): (r.status, r.reason) for r in rejects.collect()} == {
        "cut.png": (422, "broken header"), "zero.png": (422, "broken header"), "text.jpg": (422, "no known image"), "swapped.png": (422, "not of the declared type"), "empty.png": (422, "empty"), "note.txt": (415, "type not allowed"), "large.jpg": (413, "too large"),
    }
    assert taken.count() + rejects.count() == len(files)


def test_work_done_by_all_tasks_finds_the_least_nonce(spark):
    for difficulty in (1, 4):
        nonce = 0
        while True:
            text = json.dumps({"difficulty": difficulty, "index": 3, "merkle_root": "ab", "nonce": nonce, "prev_hash": ledger.GENESIS, "timestamp": "t"}, separators=(",", ":"))
            if (digest := hashlib.sha256(text.encode()).hexdigest()).startswith("0" * difficulty):
                break
            nonce += 1
        assert ledger.mined(spark, 3, "t", ledger.GENESIS, "ab", difficulty, span=1 << 14) == (nonce, digest)


def test_answers_that_are_no_object(spark):
    texts = ['[{"summary": "x"}]', '```json\n{"summary": "a", "corroboration": ["c", ""], "uncertainties": ["u"]}\n```', 'so: {"summary": "b"} ok', '"{}"', "none", None]
    rows = spark.createDataFrame([(i, t, "LOW") for i, t in enumerate(texts)], "doc_id long, answer string, level string")
    got = {r.doc_id: r for r in fusion.model_answers(rows).collect()}
    assert [got[i].parsed for i in range(6)] == [False, True, True, False, False, False]
    assert (got[1].summary, got[1].corroboration, got[1].uncertainties, got[1].contradictions, got[2].summary) == ("a", ["c"], ["u"], [], "b")


def test_json_of_a_record_is_one_step_of_a_short_plan(spark):
    schema = "doc_id long, evidence array<struct<id:string,kind:string,field:string,message:string,confidence:double,region:array<int>>>, risk struct<level:string,why:string,base:double,bonus:double>"
    rows = spark.createDataFrame([], schema).repartition(2)
    plan = ledger.with_hash(rows.withColumns({c: F.lit("x") for c in ledger.HASHED if c != "payload"} | {"payload": F.struct("evidence", "risk")}))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    kind = "w struct<f:float,m:map<int,double>,b:binary,c:decimal(3,2),d:date,n:struct<x:date>>"
    whole = spark.createDataFrame([((0.1, {1: 2.5}, bytearray(b"\x00\xff"), decimal.Decimal("1.50"), datetime.date(2024, 1, 2), None),)], kind)
    assert whole.select(json_text(F.col("w"), whole.schema["w"].dataType).alias("j")).first()[0] == '{"b":"AP8=","c":"1.50","d":"2024-01-02","f":0.10000000149011612,"m":{"1":2.5},"n":null}'


def test_shares_take_the_sum_once(spark):
    began = time.time()
    row = spark.range(1).select(calibrate.shares(F.sequence(F.lit(1), F.lit(20_000))).alias("s")).first()
    assert sum(row.s) == pytest.approx(1) and time.time() - began < 20  # 20,000 sums of 20,000 take minutes


def test_lines_of_whole_pages_are_those_of_their_words_and_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "b a  c\n\n x\n"), (2, ""), (3, None), (4, "one\ntwo \"2\" é")], "doc_id long, text string")
    whole = text.page_lines(workload.document_lines(docs))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, text.lines(workload.document_words(docs)).collect())) != []
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_the_chain_grow_with_the_customers(spark, monkeypatch):
    monkeypatch.setattr(synth, "TO_PART", 10)
    n = -(-spark.read.parquet(f"{SF}/customer.parquet").count() // 10)
    assert n > 4 and synth.people(spark, SF).rdd.getNumPartitions() == n
    assert registry.dealt(spark, SF, spark.range(9).withColumnRenamed("id", "doc_id")).rdd.getNumPartitions() == n
