"""SQL for the corpus operators whose results SQL can state."""

_WORDS = "list_filter(string_split(translate(coalesce({0}, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
low AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN low USING (win) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = words.doc_id AND g.i = words.i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS.format("text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT win.r, unnest(range(i, i + 5)) AS p FROM win JOIN twice ON win.r = twice.r AND win.g = twice.g)
  GROUP BY r),
line AS (
  SELECT r, coalesce('d' || doc_id, 'r' || r) AS doc, source, lower(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) AS k, len({_WORDS.format("x")}) AS n
  FROM (SELECT r, doc_id, source, unnest(l) AS x FROM d)),
host AS (SELECT source, count(DISTINCT coalesce('d' || doc_id, 'r' || r)) AS docs FROM d GROUP BY source),
common AS (
  SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT doc) AS n FROM line GROUP BY source, k) c
  JOIN host ON c.source IS NOT DISTINCT FROM host.source WHERE c.n > 10 AND c.n > least(0.02 * host.docs, 200)),
gone AS (
  SELECT line.r, sum(n) AS n FROM line JOIN common ON line.source IS NOT DISTINCT FROM common.source AND line.k = common.k
  GROUP BY line.r),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN gone ON d.r = gone.r)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words - n_common_words >= 10 AND n_words - n_common_words >= 0.5 * n_words AS kept
FROM s
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM both_have JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r LEFT JOIN n ON r.doc_id = n.doc_id
"""


def _crc(value: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({value})), lambda i: (ascii({value}[i // 8 + 1]) >> (i % 8)) & 1)"
    step = "xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: {step}), 4294967295)"


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(depth: int = 6, top: int = 4, fan: int = 16) -> str:
    """Levels written out: enough for ``fan ** depth`` rows a source and ``fan ** top`` sources."""
    framed = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"""leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS h,
  CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(_LOW.format("text"))} END AS o FROM documents)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{name}w{k} AS (SELECT *, list(h) OVER (PARTITION BY g, i // {fan} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // {fan} AS i, (n + {fan - 1}) // {fan} AS n, sha256(array_to_string(run, '')) AS h FROM {name}w{k} WHERE n > 1 AND i % {fan} = 0)")
        parts.append(f"{name}roots AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    tree("a", depth)
    parts.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS source FROM aroots)")
    tree("b", top)

    def up(name: str, rows: str, first: str, levels: int, fold: str, proof: str) -> str:
        """Take folded values and siblings up the levels of a tree, row by row."""
        for k in range(levels):
            before = rows
            rows = f"{first}{k}"
            parts.append(
                f"""{rows} AS (SELECT r.* REPLACE (
  CASE WHEN w.n > 1 THEN sha256(array_to_string(list_slice(w.run, 1, w.i % {fan}), '') || r.{fold} || array_to_string(list_slice(w.run, w.i % {fan} + 2, {fan}), '')) ELSE r.{fold} END AS {fold},
  CASE WHEN w.n > 1 THEN r.{proof} || array_to_string(list_slice(w.run, 1, w.i % {fan}), '') || array_to_string(list_slice(w.run, w.i % {fan} + 2, {fan}), '') ELSE r.{proof} END AS {proof},
  r.p // {fan} AS p) FROM {before} r LEFT JOIN {name}w{k} w ON w.g = r.tg AND w.i = r.p AND w.n > 1)"""
            )
        return rows

    parts.append("start AS (SELECT doc_id, h AS leaf, g, g AS tg, i AS p, coalesce(o, h) AS folded, '' AS proof FROM a0)")
    low = up("a", "start", "u", depth, "folded", "proof")
    parts.append(f"middle AS (SELECT r.doc_id, r.leaf, s.h AS subroot, 0 AS tg, s.i AS p, r.folded, r.proof FROM {low} r JOIN b0 s ON s.source = r.g)")
    high = up("b", "middle", "v", top, "folded", "proof")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, (SELECT h FROM broots) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM broots) AS verified FROM {high}"""


PREFIX_TRIE = f"""
WITH o AS (
  SELECT conv_id, g, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS r
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
x AS (
  SELECT c.conv_id, o.r AS d, o.g, o.b FROM c JOIN o ON o.conv_id = c.base AND o.r <= c.h
  UNION ALL
  SELECT c.conv_id, o.r - c.h + least(c.h, coalesce(p.n, 0)), o.g, o.b FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > c.h LEFT JOIN c p ON p.conv_id = c.base),
pre AS (
  SELECT conv_id, d, b, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM x
  UNION ALL SELECT c.conv_id, 0, 0, '', coalesce(s.n, 0) FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM x GROUP BY conv_id) s ON s.conv_id = c.conv_id),
node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM pre GROUP BY d, k),
linked AS (
  SELECT node.*, up.conv_id AS parent FROM node LEFT JOIN pre p ON p.conv_id = node.conv_id AND p.d = node.d - 1 LEFT JOIN node up ON up.d = p.d AND up.k = p.k),
kids AS (SELECT d - 1 AS d, parent, count(*) AS n FROM linked WHERE d > 0 GROUP BY d, parent),
below AS (
  SELECT p.d, p.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((l.n_convs - 1) * l.b) AS saved
  FROM linked l LEFT JOIN kids ON kids.d = l.d AND kids.parent = l.conv_id JOIN pre p ON p.conv_id = l.conv_id AND p.d <= l.d GROUP BY p.d, p.k)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, l.parent AS parent_conv_id, CAST(l.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM linked l JOIN below ON below.d = l.d AND below.k = l.k LEFT JOIN kids ON kids.d = l.d AND kids.parent = l.conv_id
"""

URL_FILTER = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
host AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM cut),
part AS (
  SELECT page_id, {_LOW.format("h0")} AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path,
    list_sort(list_filter(string_split(regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|\z)'))) AS asked
  FROM host),
bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)\z', ''), '^(www|m|mobile)\.', '') AS b,
    regexp_replace(regexp_replace(path, '(/index)?\.html\z', ''), '/+\z', '') AS p FROM part),
named AS (SELECT *, CASE WHEN b <> '' THEN b || p || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical FROM bare),
bad AS (SELECT DISTINCT canonical FROM named WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules AS (SELECT unnest(['block', 'allow', 'block', 'allow']) AS say, unnest(['net', 'example.net', 'example.com', 'org']) AS rh, unnest(['/', '/en/', '/de/', '/fr/']) AS rp),
ruled AS (
  SELECT named.*, (SELECT max_by(rh || rp || ' ' || say, length(rh || rp)) FROM rules WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)) AS r FROM named)
SELECT page_id, host, path, split_part(r, ' ', 1) AS rule, coalesce(split_part(r, ' ', 2), CASE WHEN canonical IN (SELECT canonical FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
  canonical, coalesce(canonical IN (SELECT canonical FROM bad), false) AS listed
FROM ruled
"""

SQL = {"op2_quality_rules": QUALITY_RULES, "op7_near_dedup": NEAR_DEDUP, "op8_substring_dedup": SUBSTRING_DEDUP, "op11_merkle_manifest": merkle_sql(), "op12_prefix_trie": PREFIX_TRIE, "op13_url_filter": URL_FILTER}
