"""The ten operators as queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronbase.llm.common import table, vocabulary


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.substring_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.pii import extract

    return extract(table(spark, sf_dir, "documents"))


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heronbase.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.common import pick
    from heronbase.llm.toxicity import score

    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.suffix_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op6_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.rans import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc", "version")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heronbase.llm.common import pick
    from heronbase.llm.quality import score

    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    graded = score(docs, table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "held_out", F.col("tail").alias("score"), F.col("selected").cast("int").alias("predicted"), "expected_grade", "selected")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronbase.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _nibbles(text: str, n: int) -> str:
    """DuckDB: the number that the first ``n`` hex digits of ``md5(text)`` spell."""
    return "(" + " + ".join(f"{16 ** (n - i)} * (strpos('0123456789abcdef', substr(md5({text}), {i}, 1)) - 1)" for i in range(1, n + 1)) + ")"


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
w AS (SELECT doc_id, pos, md5(string_agg(word, ' ') OVER x) AS win, count(*) OVER x AS n FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS first FROM w WHERE n = 13),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE first < doc_id),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.pos) AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos WHERE r.pos IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM w),
r AS (SELECT doc_id, i, i + 200 AS e, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE n > 1),
g AS (SELECT doc_id, i, e, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
s AS (SELECT doc_id, min(i) AS a, max(e) AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM s),
t AS (
  SELECT k.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), b AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)::INT) END AS class,
         {_nibbles("coalesce(CAST(doc_id AS VARCHAR), text, '')", 2)} AS bucket FROM d
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (SELECT source, source_size, least(most, (max(level) OVER ()) * weight) AS target FROM l),
r AS (SELECT b.*, row_number() OVER (PARTITION BY source ORDER BY class, bucket, doc_id NULLS LAST, size) AS pos FROM b),
c AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.pos, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         {_nibbles("'mix|' || coalesce(r.source, '')", 4)} / 65536.0::DOUBLE AS off
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), n AS (SELECT *, CAST(least(floor(rate * pos + off) - floor(rate * (pos - 1) + off), 2) AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n
"""

_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS8} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, words[k : k + 12] AS words FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS k FROM i WHERE len(words) > 0)
), d AS (SELECT doc_id, {_WORDS8} AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
f AS (SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead FROM p),
h AS (SELECT f.doc_id, f.pos, w.item_id, len(w.words) AS n FROM f JOIN w ON f.word = w.words[1] WHERE f.ahead[1 : len(w.words)] = w.words),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit, max(n) >= 13 AS whole_window FROM (SELECT doc_id, n, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY doc_id),
rare AS (
  SELECT item_id, words, arg_min(x.word, cf) AS word FROM (SELECT item_id, words, unnest(words) AS word FROM w) x JOIN (SELECT word, count(*) AS cf FROM p GROUP BY word) y ON x.word = y.word
  GROUP BY item_id, words
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT p.doc_id, item_id, rare.words AS words, least(pos - 1, 15) AS lead, d.words[greatest(pos - 15, 1) : pos + 15] AS around FROM p JOIN rare ON p.word = rare.word JOIN d ON p.doc_id = d.doc_id
  ) WHERE list_has_all(around, words) AND len(list_filter(range(greatest(1, lead - 1 - len(words)), lead + 2), lambda s: list_has_all(around[s : s + len(words) + 2], words))) > 0
  GROUP BY doc_id
), j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated,
       coalesce(whole_window, false) AS whole_window, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN near USING (doc_id)
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bootstrapped_pii": op2_bootstrapped_pii,
    "op3_block_topk": op3_block_topk,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_rans_tokens": op6_rans_tokens,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op3_block_topk": OP3_SQL, "op5_suffix_array_dedup": OP5_SQL, "op7_systematic_mix": OP7_SQL, "op8_benchmark_decontamination": OP8_SQL}
