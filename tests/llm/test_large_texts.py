"""Very long texts and hot keys, which the small fixtures don't have."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import by_words, fixture
from vellum.llm import near_dup
from vellum.llm.common import maybe_among
from vellum.llm.mixing import mixed
from vellum.llm.near_dup import near_duplicates
from vellum.llm.secret_scan import ASSIGN, HEX, secret_spans
from vellum.llm.substring_dedup import substring_dedup


def test_secrets_of_a_text_with_200_000_matches(spark):
    many = " ".join(f"{i * 2654435761 % 2**64:016x}" for i in range(200_000))
    mix = " ".join(f"token=abcdefghij{i:06d} GhKl{i:06d}QrStUvWxYzGHJKLMNP{'' if i % 3 else f' {i:020x}'}" for i in range(20_000))
    began = time.time()
    got = {r.doc_id: r for r in secret_spans(fixture(spark, [(1, many, "a"), (2, mix, "b")])).collect()}
    assert time.time() - began < 90
    assert got[1].n_hex == 200_000 and got[2].n_assign == 20_000
    for i, text in ((1, many), (2, mix)):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 12] + [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(spans)).encode()).hexdigest()
    assert got[2].n_owned == 20_000  # none overlaps a base span


def test_substrings_of_a_text_of_30_000_words(spark):
    rng = np.random.default_rng(3)
    long_ = [f"w{x}" for x in rng.integers(0, 50_000, 30_000)]
    rows = [(1, " ".join(long_[5000:5400]), "a"), (2, " ".join(long_), "a"), (3, " ".join(long_[100:29_000]), "b"), (4, " ".join(reversed(long_)), "b"), (5, "lone words only", "a")]
    low = {}
    for i, t, _ in rows:
        w = by_words(t)
        for k in range(len(w) - 12):
            low.setdefault(tuple(w[k : k + 13]), i)
    want = Counter()
    for i, t, _ in rows:
        w = by_words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        want[i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert Counter(map(tuple, substring_dedup(fixture(spark, rows)).collect())) == want


def test_near_duplicates_with_a_hot_bucket(spark, monkeypatch):
    """Buckets, hubs, sets and stars above the limit of a hot key."""
    from vellum.llm import common

    for f in (near_dup.spread_join, common.spread_join):
        assert f.__defaults__[-1] == common.SPREAD_LEAST
    monkeypatch.setattr(near_dup, "spread_join", lambda *a, **k: common.spread_join(*a, **(k | {"share": 4, "least": 5})))
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 500, 200)]
    rows = [(i, " ".join(base[: 200 - i % 3] + [f"own{i}"]), "a") for i in range(90)] + [(100 + i, " ".join(base), "b") for i in range(60)] + [(300 + i, f"word{i} alone {i} here now then", "c") for i in range(20)] + [(400, None, "c"), (401, "", "c")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(fixture(spark, rows)).collect()}
    assert {got[i] for i in [*range(1, 90), *range(100, 160)]} == {(0, False)} and got[0] == (0, True)
    assert all(got[i] == (i, True) for i in [*range(300, 320), 400, 401])


def test_maybe_among(spark):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) AS id", "id AS row")
    ids = spark.range(0, 5000, 10).toDF("x")
    got = {r["row"]: r["maybe"] for r in maybe_among(rows, "id", ids).collect()}
    assert all(got[i] for i in range(0, 5000, 10)) and not got[7] and sum(got.values()) < 510
    assert not [r for r in maybe_among(rows, "id", ids.limit(0)).collect() if r["maybe"]]


def _pipeline_docs(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(5 + i % 40)), "en" if i % 2 else None, None if i % 11 == 0 else f"s{i % 4}") for i in range(200)]
    rows += [(5, rows[5][1], "en", "s1"), (None, "no id here", "en", "s0"), (None, None, None, None), (300, None, "en", "s1"), (301, "", "de", "s2"), (302, "word " * 3000, "en", "s3")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), i, "clash") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars int, at long, size string")


def test_the_mixing_stage_copies_rows_as_the_mix_says(spark, tmp_path):
    path = str(tmp_path / "docs")
    _pipeline_docs(spark).write.parquet(path)
    docs = spark.read.parquet(path)
    out = corpus_pipeline.mix(spark, docs, None)
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    rows = Counter(map(tuple, docs.collect()))
    assert not set(got) - set(rows)
    # By hand: water-filled targets, and copies within one of the rate for every row, three at most.
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size(r) * n for r, n in rows.items() if r[3] == s) for s in names}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        level = (sum(of.values()) - sum(3 * of[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and 3 * of[s] <= weight[s] * level}
        if not more:
            break
        full |= more
    rate = {s: (3.0 if s in full else weight[s] * level / of[s]) for s in names}
    for s in names:
        n = sum(c for r, c in rows.items() if r[3] == s)
        taken = sum(c for r, c in got.items() if r[3] == s)
        assert abs(taken - n * rate[s]) <= 1 + 1e-6
    for r, n in rows.items():
        assert n * np.floor(rate[r[3]]) - n <= got[r] <= n * np.ceil(rate[r[3]] + 1e-9) and got[r] <= 3 * n


def test_mixing_keeps_a_row_number(spark):
    docs = _pipeline_docs(spark).withColumn("mark", F.monotonically_increasing_id())
    kept, plain = mixed(docs, keep=("mark",)), mixed(docs)
    assert Counter(map(tuple, kept.drop("mark").collect())) == Counter(map(tuple, plain.collect()))
    assert kept.select("mark").distinct().count() == docs.count()


def test_the_sharding_stage_against_its_law(spark):
    """Groups of equal texts stay together, slots have no gaps, and no shard is above what the best cut of the ordered groups needs."""
    docs = _pipeline_docs(spark)
    got = corpus_pipeline.shard(spark, docs, None).collect()
    assert len(got) == docs.count()
    where = {}
    size = Counter()
    for r in got:
        where.setdefault((r.text_crc32, r["size"]) if r["size"] > 8 else r.doc_id, set()).add(r.shard)
        size[r.shard] += r["size"]
    texts = Counter()
    for r in docs.collect():
        texts[r.text or ""] += len((r.text or "").encode()) + 8
    assert all(len(s) == 1 for s in where.values())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    assert max(size.values()) <= max(max(texts.values()), -(-sum(texts.values()) // 24) + max(texts.values()))
