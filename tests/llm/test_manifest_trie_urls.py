"""Merkle manifest, prefix trie and URL filter against brute force on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import SF
from vellum.llm import oracle
from vellum.llm import prefix_trie as prefix_trie_module
from vellum.llm.common import table
from vellum.llm.merkle import folded, manifest
from vellum.llm.prefix_trie import endings, prefix_trie
from vellum.llm.queries import queries
from vellum.llm.ranks import ranked
from vellum.llm.url_filter import url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars int, key string, node string, pos int, path string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def trees(leaves):
    """Leaf positions in order to (root, for each leaf its levels of (left, right))."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i in range(len(leaves)):
            run = nodes[at[i] // 16 * 16 : at[i] // 16 * 16 + 16]
            paths[i].append(("".join(run[: at[i] % 16]), "".join(run[at[i] % 16 + 1 :])))
            at[i] //= 16
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def by_hand(rows):
    groups = defaultdict(list)
    for i, t, lang, s, n in rows:
        leaf = sha("".join(map(framed, (i, s, lang, n, t))))
        low = t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups[s].append((i is not None, i or 0, leaf, sha("".join(map(framed, (i, s, lang, n, low)))) if hit else leaf, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: trees([g[2] for g in sorted(groups[s])]) for s in names}
    root, above = trees([built[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for g, own in zip(sorted(groups[s]), built[s][1]):
            path, at = own + above[k], g[3]
            for left, right in path:
                at = sha(left + at + right)
            out[g[4], g[2], built[s][0], root, sha("".join(a + b for a, b in path)), at, at == root] += 1
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "k", "n", 7, "p") for i, t, lang, s, n in rows], DOCS)


def merkle_rows():
    rows = [(i, f"Text {i} É {'Xy' * (i % 9)}", "en", "big", i) for i in range(600)]
    rows += [(i, "Same TEXT", None, f"s{i % 23}", 5) for i in range(1000, 1060)]
    rows += [(2000, None, None, None, None), (2001, "", "de", None, 0), (None, "No id", "en", "big", 1), (None, None, None, None, None), (7, "Other 7", "en", "big", 2), (3000, "word Z " * 40_000, "en", "long", 3), (3001, "Ä", "en", "", 1)]
    return rows + [rows[5]] * 40  # equal rows


def test_manifest(spark):
    rows = merkle_rows()
    got = manifest(documents(spark, rows)).collect()
    keys = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[k] for k in keys) for r in got) == by_hand(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(4, "Alone", "en", "s", 5)]
    got = manifest(documents(spark, one)).collect()
    assert [(r.leaf, r.proof_sha256, r.path) for r in got] == [(r[1], sha(""), []) for r in by_hand(one)]
    assert manifest(documents(spark, [])).collect() == []


def test_paths_prove_a_row(spark):
    rows = merkle_rows()[:300]
    out = manifest(documents(spark, rows))
    assert out.where(folded(out["leaf"], out["path"]) != out["root"]).isEmpty()


def test_places_in_a_spread_group(spark):
    rows = spark.range(5000).selectExpr("'g' AS of", "id % 1250 AS at", "id AS row")
    got = ranked(rows, "of", ["at"], "t").collect()
    assert sorted(r.pos for r in got) == list(range(5000)) and {r.total for r in got} == {5000}
    assert all(r.pos // 4 == r["at"] for r in got)


TALK = "conv_id long, turn long, role string, text string, node string, depth int, key string"


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first, mine = ([e[3:] for e in sorted(own.get(k, []))] for k in (c - c % 5, c))
        seq[c] = first[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, of in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(of) - 1) * (len(k[-1][1].encode()) if k else 0)
    name = {k: min(of) for k, of in nodes.items()}
    return Counter((name[k], len(k), name[k[:-1]] if k else None, len(of), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in sorted(of) if len(seq[c]) == len(k)))) for k, of in nodes.items())


def talk_rows():
    rows = []
    for c in range(160):
        for t in range(c % 7 + 1):
            said = "hello" if c % 3 == 0 and t < 2 else f"é {c % 11 if t < 3 else c} {t}"
            rows.append((c, t if (c + t) % 13 else None, "user" if t % 2 == 0 else None, said if (c + t) % 17 else None))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(6)]  # equal conversations
    rows += [(500, t, "a", f"long {t}") for t in range(90)] + [(506, 0, "a", "short"), (506, 0, "a", "short"), (506, 0, "b", "tie")]
    rows += [(601, t, "x", "lost") for t in range(2)] + [(602, None, None, None), (None, 0, "user", "no id"), (700, 0, "user", "y" * 300_000)]
    return rows


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie_module, "CHUNK", 16)  # so that tails and hashes are made in parts
    rows = talk_rows()
    talk = spark.createDataFrame([(*r, "n", 1, "k") for r in rows], TALK)
    assert Counter(map(tuple, prefix_trie(talk).collect())) == trie_by_hand(rows)
    assert prefix_trie(talk.where("conv_id is null")).collect() == []


def test_endings_of_a_hot_node(spark):
    ends = spark.range(20_000).selectExpr("if(id % 20 = 0, 2L, 1L) AS depth", "if(id % 20 = 0, id, 0L) AS node", "id AS conv_id")
    got = {(r.depth, r.node): r.ends_sha256 for r in endings(ends).collect()}
    assert len(got) == 1001 and got[1, 0] == sha(",".join(str(i) for i in range(20_000) if i % 20)) and got[2, 40] == sha("40")


URLS = [
    "http://a.net/x", "https://A.B.net/y?x=1#f", "http://anet/x", "http://net/", "http://x.net", "http://www.example.net/en/1", "http://example.net/EN/1", "http://q.example.com/de/2.html", "http://example.com/fr/2", "http://x.org/fr/", "http://x.org/de/",
    "http://WWW.Good.com/p/?b=2&a=1&utm_source=z", "https://good.com:443/p?a=1&b=2#t", "http://m.good.com/p/index.html?a=1&b=2&ref=q", "http://good.com/p?a=1", "http://user@good.com:80/p//?b=2&a=1", "http://Bad.com/%41/é", "nothing", "", None, "://", "x://?q", "http://bad.com\n/z", "http://net:80/a",
]


def test_url_filter(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(11, URLS[11])] * 2100 + [(None, URLS[12])]
    pages = spark.createDataFrame([(i, u, "h", 3, True) for i, u in rows], "page_id long, url string, host string, block int, listed boolean")
    listed = spark.createDataFrame([("http://good.com/p?b=2&a=1",), (None,), ("http://x.org/fr",), ("https://x.org/de",), ("http://bad.com/%41/é/",)] + [(f"http://h{k}.com/{k}",) for k in range(500)], "url string")
    got = url_filter(pages, listed).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(r, v) for v, h, r, p in (("block", "net", "net/", "/"), ("allow", "example.net", "example.net/en/", "/en/"), ("block", "example.com", "example.com/de/", "/de/"), ("allow", "org", "org/fr/", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        method = "block" if i in (10, 11, 12, 13, 15, 16) else "allow"
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, rule[0], rule[1] or method), u
    assert by[None].verdict == "block" and sum(r.verdict == "block" and r.page_id == 11 for r in got) == 2101
    # A filter of one block passes nearly all; the exact join still decides. An empty list blocks nothing.
    key = lambda rs: Counter(map(tuple, rs))
    assert key(url_filter(pages, listed, most=1).collect()) == key(got)
    assert not [r for r in url_filter(pages, listed.limit(0)).collect() if r.listed]
    assert url_filter(pages.limit(0), listed).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_prefix_trie", "op13_url_filter"])
def test_queries_equal_their_sql(spark, name):
    got = queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(oracle.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(found.fetchall())
    assert table(spark, SF, "documents").count() > 0
