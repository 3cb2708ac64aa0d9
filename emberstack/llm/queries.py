"""The queries ``opN_<name>`` of this subpackage and, where SQL can express them, their SQL.

Each applies one operator with production parameters to its whole table and derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberstack.llm import fair_mix, host_reputation, language_id, ngram_join, packing, periodic_runs, prefix_forest, private_data, quality, quantised_tiles, scratch, spot_signatures, substring_dedup, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer() -> dict[str, str]:
    """Where the public byte-level vocabulary lies, as the tokenizers file and as ranks."""
    import public_tokenizers

    return {"tokenizers_file": public_tokenizers.path("byte_bpe_50k.json"), "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), **public_tokenizer()))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprints(table(spark, sf_dir, "documents"))


def spot_signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints and their links, by length bands and pruned Jaccard."""
    return spot_signatures.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of its number marks low quality."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = host_reputation.judge(table(spark, sf_dir, "pages"), outcomes, threshold=0.25)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document (its source in the place of a host) and each page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    units = docs.select("doc_id", none.cast("long").alias("page_id"), "text", F.col("source").alias("host"), none.cast("string").alias("declared"))
    html = F.col("html")
    units = units.unionByName(pages.select(none.cast("long").alias("doc_id"), "page_id", language_id.visible_text(html).alias("text"), host_reputation.host_of(F.col("url")).alias("host"), language_id.markup_language(html).alias("declared")))
    return language_id.identify(units, language_id.train(docs), ["doc_id", "page_id"])


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(vectors, vectors.where("vec_id % 100 = 0"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, rows = vector_codes.train(table(spark, sf_dir, "embeddings"))
    coded = scratch.saved(vector_codes.encode(rows, books))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    told = F.lit(None).cast("string")
    for d in books.entries:
        told = F.when(F.col("d") == d, books.sha256(d)).otherwise(told)
    coded = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", told.alias("codebooks_sha256"))


def op13_quantised_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised_tiles.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose number's checksum is divisible by ten first repeat a stretch of theirs to their end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    docs = docs.withColumns({"n": F.size("words"), "g": F.floor(F.col("h") / 10)})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    found = periodic_runs.collapse(docs.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text")))

    def steeper(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    found = found.withColumn("best", F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), steeper))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_spot_signatures": op2_spot_signatures,
    "op3_substring_dedup": op3_substring_dedup,
    "op5_host_reputation": op5_host_reputation,
    "op4_private_data": op4_private_data,
    "op6_quality": op6_quality,
    "op7_fair_mix": op7_fair_mix,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_prefix_forest": op10_prefix_forest,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quantised_tiles": op13_quantised_tiles,
    "spot_signature_groups": spot_signature_groups,
}

SQL: dict[str, str] = {}

SQL["op5_host_reputation"] = r"""
WITH judged AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
outcomes AS (SELECT doc_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sites AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') AS site FROM judged),
counts AS (
  SELECT site AS host, CAST(sum(coalesce(n, 0)) AS DOUBLE) AS n, CAST(sum(coalesce(bad, 0)) AS DOUBLE) AS bad
  FROM sites LEFT JOIN outcomes ON doc_id = page_id GROUP BY site),
kinds AS (
  SELECT host, n, bad, string_split(host, '.') AS labels, regexp_matches(host, '^[0-9]+(\.[0-9]+){3}\z') OR starts_with(host, '[') AS is_address,
    CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\.[a-z]{2}\z') THEN 2 ELSE 1 END AS k FROM counts),
named AS (
  SELECT host, n, bad, CASE WHEN is_address THEN host ELSE array_to_string(list_slice(labels, -k - 1, -1), '.') END AS domain,
    CASE WHEN is_address THEN '[address]' ELSE array_to_string(list_slice(labels, -k, -1), '.') END AS suffix FROM kinds),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
root AS (SELECT (sum(bad) + 0.5e0) / (sum(n) + 1e0) AS m FROM suffixes),
s1 AS (SELECT suffix, n, bad, m, bad / greatest(n, 1e0) AS r FROM suffixes, root),
f1 AS (SELECT max(m) * (1 - max(m)) AS v, (sum(n * (r - m) * (r - m)) - count(*) * max(m) * (1 - max(m))) / greatest(sum(n) - sum(n * n) / greatest(sum(n), 1e0), 1e0) AS b FROM s1),
c1 AS (SELECT least(greatest(coalesce(CASE WHEN b > 0 THEN v / b - 1 END, 1000e0), 1e0), 1000e0) AS k FROM f1),
p1 AS (SELECT suffix, (k * m + bad) / (k + n) AS mean FROM s1, c1),
s2 AS (SELECT domain, d.suffix, n, bad, mean AS m, bad / greatest(n, 1e0) AS r FROM domains d JOIN p1 ON d.suffix = p1.suffix),
f2 AS (SELECT suffix, max(m) * (1 - max(m)) AS v, (sum(n * (r - m) * (r - m)) - count(*) * max(m) * (1 - max(m))) / greatest(sum(n) - sum(n * n) / greatest(sum(n), 1e0), 1e0) AS b FROM s2 GROUP BY suffix),
c2 AS (SELECT suffix, least(greatest(coalesce(CASE WHEN b > 0 THEN v / b - 1 END, 1000e0), 1e0), 1000e0) AS k FROM f2),
p2 AS (SELECT domain, (k * m + bad) / (k + n) AS mean FROM s2 JOIN c2 ON s2.suffix = c2.suffix),
s3 AS (SELECT host, named.domain, n, bad, mean AS m, bad / greatest(n, 1e0) AS r FROM named JOIN p2 ON named.domain = p2.domain),
f3 AS (SELECT domain, max(m) * (1 - max(m)) AS v, (sum(n * (r - m) * (r - m)) - count(*) * max(m) * (1 - max(m))) / greatest(sum(n) - sum(n * n) / greatest(sum(n), 1e0), 1e0) AS b FROM s3 GROUP BY domain),
c3 AS (SELECT domain, least(greatest(coalesce(CASE WHEN b > 0 THEN v / b - 1 END, 1000e0), 1e0), 1000e0) AS k FROM f3),
p3 AS (SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM s3 JOIN c3 ON s3.domain = c3.domain),
known AS (SELECT host, 1 / (1 + exp(-(ln(a / b) - 1.645e0 * sqrt(1 / a + 1 / b)))) AS low FROM p3),
ruled AS (
  SELECT page_id, sites.host, path, low,
    CASE WHEN (sites.host = 'example.net' OR ends_with(sites.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (sites.host = 'example.com' OR ends_with(sites.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (sites.host = 'org' OR ends_with(sites.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (sites.host = 'net' OR ends_with(sites.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM sites LEFT JOIN known ON site = known.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low >= 0.25e0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

SQL["op7_fair_mix"] = r"""
WITH rows0 AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM rows0 GROUP BY source),
weighed AS (SELECT source, s, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w FROM sizes),
live AS (
  SELECT source, s, w, (s * 2) / CAST(w AS DOUBLE) AS stop, CAST(sum(s) OVER () AS DOUBLE) * 150 / 100e0 AS budget,
    CAST(sum(w) OVER () AS DOUBLE) AS all_w,
    CAST(coalesce(sum(s * 2) OVER (ORDER BY (s * 2) / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS stopped,
    CAST(coalesce(sum(w) OVER (ORDER BY (s * 2) / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS past_w
  FROM weighed WHERE s > 0),
levels AS (SELECT *, (budget - stopped) / (all_w - past_w) AS lvl FROM live),
first_free AS (SELECT lvl FROM levels WHERE stop > lvl ORDER BY stop, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, s, CASE WHEN stop > lvl THEN (SELECT lvl FROM first_free) * w ELSE CAST(s * 2 AS DOUBLE) END AS target FROM levels
  UNION ALL SELECT source, s, 0e0 FROM weighed WHERE s = 0),
placed AS (
  SELECT doc_id, r.source, size, k, s, target, row_number() OVER (ORDER BY k, doc_id, r.source, size) AS rn,
    CAST(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM rows0 r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
queue AS (SELECT *, (cum + turn * s) / target AS finish FROM placed, (SELECT unnest([0, 1]) AS turn) WHERE size > 0),
merged AS (SELECT rn, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, k, cum, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM queue),
took AS (SELECT rn, CAST(sum(size) AS BIGINT) AS taken FROM merged WHERE upto <= (SELECT CAST(sum(s) AS DOUBLE) * 150 / 100e0 FROM weighed) GROUP BY rn)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN took ON placed.rn = took.rn
"""

SQL["op3_substring_dedup"] = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rid, s, array_to_string(list_slice(ws, s, s + 34), ' ') AS body FROM w, unnest(range(1, len(ws) - 33)) AS t(s) WHERE len(ws) >= 35),
dup AS (SELECT body FROM win GROUP BY body HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM win WHERE body IN (SELECT body FROM dup)),
lists AS (SELECT rid, list(i) AS gi FROM gone GROUP BY rid),
one AS (SELECT w.rid, doc_id, ws, coalesce(gi, []) AS gi FROM w LEFT JOIN lists ON w.rid = lists.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gi) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gi, i)), ' ')) AS kept_sha256
FROM one
"""

SQL["op8_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + 3), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(s) WHERE len(ws) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON a.doc_id = x.doc_id JOIN sizes y ON b.doc_id = y.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, c FROM reach JOIN links ON a = id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM reach WHERE id = w.doc_id) AS component_id
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id
"""

SQL["op12_periodic_runs"] = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM documents),
placed AS (SELECT rid, doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN CAST(h // 10 AS BIGINT) END AS g FROM numbered),
stretched AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM placed),
made AS (
  SELECT rid, doc_id, n, CASE WHEN g IS NULL THEN ws ELSE list_concat(list_slice(ws, 1, a), list_slice(flatten(list_transform(range((n - a) // p + 1), lambda k: list_slice(ws, a + 1, a + p))), 1, n - a)) END AS ws
  FROM stretched),
word AS MATERIALIZED (SELECT rid, n, unnest(range(n)) AS i, unnest(ws) AS w FROM made),
pair AS (SELECT x.rid, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island FROM word x JOIN word y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT rid, q, min(i) AS s, count(*) + q AS l FROM pair GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT rid, s, l, min(q) AS q FROM stretch GROUP BY rid, s, l),
listed AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM run GROUP BY rid),
best AS (SELECT rid, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS k FROM run) WHERE k = 1),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT word.rid, string_agg(w, ' ' ORDER BY word.i) AS body FROM word LEFT JOIN gone ON word.rid = gone.rid AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM made LEFT JOIN listed ON made.rid = listed.rid LEFT JOIN best ON made.rid = best.rid LEFT JOIN kept ON made.rid = kept.rid
"""

#: Each round of op11: the nearest entry of every part, then floored means, an entry without parts unchanged.
_NEAREST = """a{k} AS MATERIALIZED (
  SELECT rid, p, min(far * 256 + e) AS best FROM (
    SELECT rid, part.p, e, CAST(sum((part.x - book.x) * (part.x - book.x)) AS BIGINT) AS far FROM part JOIN b{k} book ON part.p = book.p AND part.pos = book.pos GROUP BY rid, part.p, e)
  GROUP BY rid, p)"""
_MEANS = """b{n} AS MATERIALIZED (
  SELECT b{k}.p, b{k}.e, b{k}.pos, CASE WHEN c IS NULL THEN b{k}.x ELSE (s - (s % c + c) % c) // c END AS x
  FROM b{k} LEFT JOIN (SELECT part.p, best % 256 AS e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM part JOIN a{k} ON part.rid = a{k}.rid AND part.p = a{k}.p GROUP BY part.p, best % 256, pos) m
    ON b{k}.p = m.p AND b{k}.e = m.e AND b{k}.pos = m.pos)"""

SQL["op11_vector_codes"] = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT rid, i // w AS p, i % w AS pos, x FROM (SELECT rid, len(v) // 8 AS w, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, pos, x FROM part WHERE rid <= 16),
"""
    + ",\n".join(x for k in range(6) for x in (_NEAREST.format(k=k), _MEANS.format(k=k, n=k + 1)))
    + ",\n"
    + _NEAREST.format(k=6)
    + """,
coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a6 GROUP BY rid),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded ON kept.rid = coded.rid, digest
"""
)

SQL["op13_quantised_tiles"] = """
WITH RECURSIVE named AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fit AS MATERIALIZED (
  SELECT rid, vec_id, label, v FROM named WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, b.vec_id FROM fit a JOIN fit b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, c) AS (SELECT rid, vec_id FROM named UNION SELECT a, c FROM reach JOIN link ON b = id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM named JOIN least ON rid = id LEFT JOIN counted ON rid = a
"""
