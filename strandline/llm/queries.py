"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, jaccard_join, langid, licenses, merkle, mixing, oracles, ppm, quality, sharding, simhash, throttle
from .staging import staged, table

MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE = (3, 5)
MIX_EPOCHS = 2
MIX_SEED = 17

#: Both engines: a source's domain from its last character (the tables have no domain column).
DOMAIN_SQL = "CASE ascii(right(coalesce(source, ''), 1)) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(DOMAIN_SQL).alias("domain"), mixing.count_words("text").alias("n_tokens"))
    slim = staged(docs, "mixing")
    return mixing.mix(slim, weights=MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED, tokens=F.col("n_tokens")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _level_sql(name: str, above: list[str], column: str, weights: dict[str, int], source: str) -> str:
    w = "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    path = ", ".join([*above, column])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    return f"""
{name}_n AS (SELECT {path}, CAST(sum(cap) AS HUGEINT) AS ncap, any_value(got) AS b, CAST({w} AS HUGEINT) AS w FROM {source} GROUP BY {path}),
{name}_o AS (SELECT *, coalesce(sum(ncap) OVER ({part} ORDER BY CAST(ncap AS DOUBLE) / w, {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
  sum(w) OVER ({part} ORDER BY CAST(ncap AS DOUBLE) / w, {column} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onw FROM {name}_n),
{name}_f AS (SELECT *, (ncap * onw <= (b - bef) * w) AS isfull FROM {name}_o),
{name}_u AS (SELECT *, sum(CASE WHEN isfull THEN ncap ELSE 0 END) OVER ({part}) AS used, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({part}) AS op FROM {name}_f),
{name}_g AS (SELECT {path}, CASE WHEN isfull THEN ncap WHEN op = 0 THEN 0 ELSE (b - used) * w // op END AS nxt FROM {name}_u),
{name} AS (SELECT s.* EXCLUDE (got), g.nxt AS got FROM {source} s JOIN {name}_g g USING ({path}))"""


OP1_SQL = (
    f"""WITH d AS (SELECT doc_id, lang, source, {DOMAIN_SQL} AS domain, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
e AS (SELECT *, domain AS m FROM d WHERE n > 0),
t AS (SELECT m, l, s, CAST(sum(n) AS HUGEINT) AS leaf, CAST(sum(n) * {MIX_EPOCHS} AS HUGEINT) AS cap FROM e GROUP BY m, l, s),
z AS (SELECT *, CAST(sum(leaf) OVER () AS HUGEINT) * {MIX_SHARE[0]} // {MIX_SHARE[1]} AS got FROM t),"""
    + _level_sql("la", [], "m", MIX_WEIGHTS["domain"], "z")
    + ","
    + _level_sql("lb", ["m"], "l", MIX_WEIGHTS["lang"], "la")
    + ","
    + _level_sql("lc", ["m", "l"], "s", {}, "lb")
    + f""",
x AS (SELECT e.*, got // leaf AS whole, got % leaf AS rest FROM e JOIN lc USING (m, l, s) WHERE got > 0),
y AS (SELECT *, unnest(range(CAST(whole AS BIGINT) + 1)) AS epoch FROM x),
k AS (SELECT *, md5(concat('{MIX_SEED}:', epoch, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM y),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY m, l, s, epoch ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM k)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch < whole THEN n ELSE least(n, rest - bef) END AS BIGINT) AS take_tokens
FROM c WHERE epoch < whole OR bef < rest"""
)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), prefer="largest")


OP3_SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels, learn_from=~langid.held_out("doc_id", 4, 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.train(docs.where(~langid.held_out("doc_id", 5, 0)))
    found = langid.classify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


#: Both engines: the tables have no paths, so a document's place follows from its columns.
PATH_SQL = "concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', CAST(doc_id % 16 AS {string}), '/', CAST(doc_id AS {string}), '.txt')"


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH_SQL.format(string="STRING")).alias("path"))
    return licenses.scan(docs)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op12_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.throttle(table(spark, sf_dir, "clicks"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.without_line_ends())


def _op10_sql() -> str:
    rows, idf, other = licenses.template_weights()
    weights = ", ".join(f"('{t}', '{name}', {i}, {w!r}::DOUBLE)" for t, name, i, w in rows)
    known = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in sorted(idf.items()))
    token = licenses.TOKEN
    gate = ", ".join(f"'{w}'" for w in licenses.gate_words())
    strong = ", ".join(f"'{w}'" for w in licenses.gate_words() if w not in licenses.COMMON)
    sizes = ", ".join(f"('{name}', {i}, {len(words)})" for name, i, words in licenses.template_texts())
    return f"""WITH tw(token, licence, template, weight) AS (VALUES {weights}), ti(token, idf) AS (VALUES {known}), tz(licence, template, words) AS (VALUES {sizes}),
d AS (SELECT doc_id, coalesce(text, '') AS t, {PATH_SQL.format(string="VARCHAR")} AS path FROM documents),
sp AS (SELECT doc_id, string_split(regexp_replace(t, '([.;!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS s FROM d),
sg AS (SELECT doc_id, i, regexp_extract_all(lower(seg), '{token}') AS toks FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS seg FROM sp)),
h AS (SELECT doc_id, sum(len(toks)) AS n_words FROM sg GROUP BY doc_id),
cu AS (SELECT * FROM sg WHERE list_has_any(toks, [{gate}])),
rn AS (SELECT *, sum(CASE WHEN i - prev <= {licenses.GAP + 1} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM sg WHERE list_has_any(toks, [{strong}]))),
le AS (SELECT doc_id, min(i) AS a FROM rn GROUP BY doc_id),
rr AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM rn GROUP BY doc_id, r HAVING min(i) < max(i)),
k AS (SELECT doc_id, i AS unit, toks FROM cu UNION ALL SELECT rr.doc_id, -(a + 2), flatten(list(toks ORDER BY i)) FROM rr JOIN sg ON sg.doc_id = rr.doc_id AND i BETWEEN a AND b GROUP BY rr.doc_id, a
  UNION ALL SELECT le.doc_id, -a - {licenses.TITLES}, flatten(list(toks ORDER BY i)) FROM (SELECT le.doc_id, a, min(i) AS b FROM le LEFT JOIN sg ON sg.doc_id = le.doc_id AND i > a AND len(toks) > 0 GROUP BY ALL) le JOIN sg ON sg.doc_id = le.doc_id AND i IN (a, b) GROUP BY le.doc_id, a),
tf AS (SELECT doc_id, unit, token, count(*) AS tf FROM (SELECT doc_id, unit, unnest(toks) AS token FROM k) GROUP BY ALL),
x AS (SELECT tf.*, (1 + ln(tf::DOUBLE)) * coalesce(idf, {other!r}::DOUBLE) AS x FROM tf LEFT JOIN ti USING (token)),
nm AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
dt AS (SELECT doc_id, unit, licence, template, sum(x * weight) AS dot FROM x JOIN tw USING (token) GROUP BY ALL),
sc AS (SELECT doc_id, unit, licence, template, round(dot / norm, 6) AS cosine FROM dt JOIN nm USING (doc_id, unit) WHERE round(dot / norm, 6) >= {licenses.LEAST}),
bu AS (SELECT doc_id, unit, cosine, licence, words FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY cosine DESC, licence, template) = 1) JOIN tz USING (licence, template)),
vo AS (SELECT doc_id, licence, sum(CAST(round(cosine * 1000000) AS BIGINT) * least(len(toks), words) * CASE WHEN CASE WHEN unit <= -{licenses.TITLES} THEN -unit - {licenses.TITLES} WHEN unit < 0 THEN -unit - 2 ELSE unit END < {licenses.TITLE_LINES} THEN {licenses.TITLE} ELSE 1 END) AS voice, max(cosine) AS cosine FROM bu JOIN k USING (doc_id, unit) GROUP BY doc_id, licence),
cv AS (SELECT doc_id, greatest(sum(CASE WHEN unit >= 0 THEN len(toks) ELSE 0 END), max(CASE WHEN unit < 0 THEN len(toks) ELSE 0 END)) AS covered FROM bu JOIN k USING (doc_id, unit) GROUP BY doc_id),
ow AS (SELECT doc_id, licence, cosine FROM vo QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY voice DESC, licence) = 1),
fi AS (SELECT h.doc_id, regexp_replace(d.path, '/[^/]*$', '') AS dir, licence, cosine FROM ow JOIN h USING (doc_id) JOIN d USING (doc_id) JOIN cv USING (doc_id) WHERE covered >= {licenses.FILE_SHARE} * n_words),
ld AS (SELECT dir AS licence_dir, licence, cosine FROM fi QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
ds AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM d),
an AS (SELECT dir, array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') AS licence_dir FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM ds)),
nr AS (SELECT an.dir, ld.* FROM an JOIN ld USING (licence_dir) QUALIFY row_number() OVER (PARTITION BY an.dir ORDER BY length(licence_dir) DESC) = 1)
SELECT d.doc_id, d.path, coalesce(ow.licence, nr.licence) AS licence,
  CASE WHEN ow.licence IS NOT NULL THEN 'own' WHEN nr.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  coalesce(ow.cosine, nr.cosine) AS cosine, CASE WHEN ow.licence IS NULL THEN nr.licence_dir END AS licence_dir
FROM d LEFT JOIN ow USING (doc_id) LEFT JOIN nr ON nr.dir = regexp_replace(d.path, '/[^/]*$', '')"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_langid": op4_langid,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html": op6_html,
    "op7_ppm": op7_ppm,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_licenses": op10_licenses,
    "op11_simhash": op11_simhash,
    "op12_throttle": op12_throttle,
    "op13_merkle": op13_merkle,
}
ORACLES = {
    "op1_mixing": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_jaccard_join": oracles.OP5_SQL,
    "op8_decontaminate": oracles.OP8_SQL,
    "op9_sharding": oracles.op9_sql(),
    "op10_licenses": _op10_sql(),
    "op12_throttle": oracles.op12_sql(),
    "op13_merkle": oracles.op13_sql(),
}
