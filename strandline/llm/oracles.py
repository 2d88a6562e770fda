"""SQL of the operators whose results SQL can express only at length (DuckDB)."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows by equality, positions hit, items by window.
OP8_SQL = f"""WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bk AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS win FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM bk)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""

#: Counts the shingles that each two sets share; classes by reachability.
OP5_SQL = rf"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, {_LOWER} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')) END)) AS s FROM w),
g AS MATERIALIZED (SELECT row_number() OVER () AS g, s, len(s) AS n, min(doc_id) AS first FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT g, n, unnest(s) AS sh FROM g),
p AS (SELECT a.g AS a, b.g AS b FROM x a JOIN x b ON a.sh = b.sh AND a.g < b.g AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(g, o) AS (SELECT g, g FROM g UNION SELECT reach.g, e.b FROM reach JOIN e ON e.a = reach.o),
c AS (SELECT reach.g AS g, min(o.first) AS first FROM reach JOIN g o ON o.g = reach.o GROUP BY reach.g)
SELECT doc_id, len(s.s) AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE c.first END AS component_id
FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN c ON c.g = g.g"""

# Fixed values of xxHash64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WRAP = 1 << 64


def _mul(x: str, factor: int) -> str:
    return f"CAST(CAST({x} AS UHUGEINT) * {factor % WRAP} % {WRAP} AS UBIGINT)"


def _add(x: str, term: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + {term}) % {WRAP} AS UBIGINT)"


def _rotl(x: str, bits: int) -> str:
    return f"({_mul(x, 1 << bits)} | ({x} >> {64 - bits}))"


def hashed(source: str, seed: str, value: str, into: str, wide: bool) -> str:
    """``source`` with ``into``: xxHash64 of one integer of 8 (``wide``) or 4 bytes, on top of the
    hash ``seed``; a null leaves the seed as it is.  One step a subquery, as each is used twice."""
    word = _mul(f"CAST({value} AS UBIGINT)", P2) if wide else f"CAST({value} AS UBIGINT)"
    lane = _mul(_rotl("_word", 31), P1) if wide else _mul("_word", P1)
    start = f"xor({_add(seed, P5 + (8 if wide else 4))}, _lane)"
    mixed = _add(_mul(_rotl("_start", 27), P1), P4) if wide else _add(_mul(_rotl("_start", 23), P2), P3)
    steps = {"_word": word, "_lane": lane, "_start": start, "_mixed": mixed, "_once": _mul("xor(_mixed, _mixed >> 33)", P2), "_twice": _mul("xor(_once, _once >> 29)", P3)}
    for name, step in steps.items():
        source = f"(SELECT *, {step} AS {name} FROM {source})"
    return f"(SELECT * EXCLUDE ({', '.join(steps)}), CASE WHEN {value} IS NULL THEN {seed} ELSE xor(_twice, _twice >> 32) END AS {into} FROM {source})"


#: The checksum's table, as one row ``rule(tab)``; then crc32 of a list of bytes.
RULE_SQL = "rule AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"


def crc32_sql(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree_sql(name: str, nodes: str) -> str:
    """All nodes of the trees of ``nodes`` (tree, pos, digest), and what stands beside each."""
    return f"""{name}(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, digest, count(*) OVER (PARTITION BY tree) FROM {nodes}
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3, n),
{name}_beside AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS h
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """``start`` (r, tree, pos, cur, proof) folded up to its tree's root."""
    return f"""{name}_all(r, tree, level, pos, cur, proof) AS (SELECT r, tree, 0, pos, cur, proof FROM {start}
  UNION ALL SELECT f.r, f.tree, f.level + 1, f.pos // 3, sha256(b.l || f.cur || b.h), f.proof || b.l || b.h FROM {name}_all f JOIN {tree}_beside b ON b.tree = f.tree AND b.level = f.level AND b.pos = f.pos),
{name} AS (SELECT r, arg_max(cur, level) AS cur, arg_max(proof, level) AS proof FROM {name}_all GROUP BY r)"""


def op13_sql() -> str:
    own, changed = (" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) for text in ("text", "replace(text, chr(10), '')"))
    return f"""WITH RECURSIVE {RULE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree, sha256({own}) AS leaf, sha256({changed}) AS changed, {crc32_sql("CAST(doc_id AS VARCHAR)")} & 1 = 0 AS even FROM documents, rule),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_tree_sql("up", "(SELECT tree, pos, leaf AS digest FROM p)")},
sub AS (SELECT tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
{_tree_sql("top", "(SELECT 'all' AS tree, pos, digest FROM sub)")},
{_fold_sql("inner_", "up", "(SELECT r, tree, pos, CASE WHEN even THEN changed ELSE leaf END AS cur, '' AS proof FROM p)")},
{_fold_sql("outer_", "top", "(SELECT r, 'all' AS tree, sub.pos, cur, proof FROM inner_ JOIN p USING (r) JOIN sub ON sub.source = p.tree)")}
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top.digest AS verified
FROM p JOIN sub ON sub.source = p.tree JOIN outer_ USING (r) JOIN top ON top.n = 1"""


def op12_sql(batches: int = 8, cost: int = 900_000_000, lateness: int = 604_800_000_000) -> str:
    """Each client's k-th click after its click before."""
    order = "CASE WHEN click_id IS NULL THEN 0 ELSE 1 END, click_id"
    return f"""WITH RECURSIVE {RULE_SQL},
u AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) // 3600000000 AS h FROM u),
b AS (SELECT click_id, client_id, us, least(coalesce((h - lo) * {batches} // (hi - lo + 1), 0) + CASE WHEN {crc32_sql("CAST(click_id AS VARCHAR)")} % 7 = 0 THEN 1 ELSE 0 END, {batches - 1}) AS own FROM h, (SELECT min(h) AS lo, max(h) AS hi FROM h), rule),
w AS (SELECT k, (SELECT max(us) FROM b WHERE own < k) - {lateness} AS w FROM (SELECT unnest(range({batches})) AS k)),
x AS MATERIALIZED (SELECT b.*, coalesce(us < o.w, false) AS late, row_number() OVER () AS r FROM b JOIN w o ON o.k = own),
d AS (SELECT x.r, coalesce(min(w.k), {batches - 1}) AS batch FROM x LEFT JOIN w ON w.k > own AND us < w.w GROUP BY x.r),
s AS MATERIALIZED (SELECT click_id, client_id, us, batch, row_number() OVER (PARTITION BY client_id ORDER BY us, {order}) AS k FROM x JOIN d USING (r) WHERE NOT late),
g(client_id, k, us, click_id, batch, gain, ok, credit, penalty) AS (
  SELECT client_id, k, us, click_id, batch, {5 * cost}, true, {4 * cost}, CAST(NULL AS BIGINT) FROM s WHERE k = 1
  UNION ALL SELECT client_id, k, us, click_id, batch, gain, gain >= {cost}, CASE WHEN gain >= {cost} THEN gain - {cost} ELSE gain END, CASE WHEN gain >= {cost} THEN NULL ELSE coalesce(penalty, us) END
  FROM (SELECT s.*, least({5 * cost}, g.credit + s.us - g.us) AS gain, g.penalty FROM g JOIN s ON s.client_id = g.client_id AND s.k = g.k + 1))
SELECT click_id, CASE WHEN ok THEN 'admitted' ELSE 'throttled' END AS outcome, CAST(batch AS INTEGER) AS batch, CAST(credit AS BIGINT) AS credit_after, penalty AS penalty_start_us, CASE WHEN NOT ok THEN us + {cost} - credit END AS penalty_end_us FROM g
UNION ALL SELECT click_id, 'late', CAST(own AS INTEGER), NULL, NULL, NULL FROM x WHERE late"""


def op9_sql(n_shards: int = 40) -> str:
    """Equal weights: the shard of the largest draw.  The checksum goes byte by byte by its table."""
    seed = "CAST(42 AS UBIGINT)"
    draws = f"(SELECT DISTINCT doc_id, unnest(range({n_shards + 1})) AS shard FROM documents)"
    draws = hashed(hashed(draws, seed, "doc_id", "of_key", True), "of_key", "shard", "draw", False)
    buckets = hashed("sized", seed, "7", "h0", False)
    for i, value in enumerate(("doc_id", "text_crc32", "size")):
        buckets = hashed(buckets, f"h{i}", value, f"h{i + 1}", True)
    return f"""WITH rule AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
raw AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
sized AS (SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM raw, rule),
home AS (SELECT doc_id, arg_max(shard, (draw >> 11, -shard)) FILTER (WHERE shard < {n_shards}) AS home, arg_max(shard, (draw >> 11, -shard)) AS grown FROM {draws} GROUP BY doc_id)
SELECT b.doc_id, size, text_crc32, 'key' AS law, CAST(home AS INTEGER) AS shard, row_number() OVER (PARTITION BY home ORDER BY h3 & 63, b.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM {buckets} b JOIN home ON b.doc_id IS NOT DISTINCT FROM home.doc_id"""
