"""Queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import es_mix, exthash, fm_decontam, license_tfidf, mil_quality, nb_toxic, pii_boost, secret_markov, simhash, token_prefix


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), fm_decontam.items_digest(F.col("items")).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op2_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.find(_docs(spark, sf_dir))


def op3_es_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es_mix.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_nb_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return nb_toxic.score(docs, nb_toxic.train(docs, _labels(spark, sf_dir)))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return mil_quality.score(docs, mil_quality.train(docs, _labels(spark, sf_dir)))


def op6_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(_docs(spark, sf_dir)).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_exthash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exthash.dedup(_docs(spark, sf_dir))


def op8_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_prefix.counts(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_markov.find(_docs(spark, sf_dir))


def op10_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = license_tfidf.scan(_docs(spark, sf_dir).withColumn("path", path))
    return found.select(F.col("id").alias("doc_id"), "license", "cosine", "license_file", "inherited", "license_from")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


#: Documents' words against the windows of each length that the items have.
OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN win USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: The same steps as the operator's, with one running sum over each source.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS n_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS draw
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST(draw AS DOUBLE) + 1.0) / 4503599627370497.0)
         / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(CAST(n_chars AS DOUBLE) / size - 6.0::DOUBLE) / 6.0::DOUBLE) ELSE 1.0 END) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM k GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS FIRST) AS pos,
         2.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
b AS (
  SELECT *, 1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size,
         all_w - coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM o),
f AS (SELECT min(pos) AS first FROM b WHERE NOT (ratio * rest_w <= rest_size)),
t AS (
  SELECT source, source_size,
         CASE WHEN first IS NULL OR pos < first THEN 2.0::DOUBLE * source_size
              ELSE w * (SELECT rest_size FROM b, f WHERE pos = first) / (SELECT rest_w FROM b, f WHERE pos = first) END AS target
  FROM b, f),
p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS prefix
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN target - epochs * source_size > 0 AND 2 * prefix - size <= 2 * (target - epochs * source_size) THEN size ELSE 0 END AS BIGINT) AS taken
FROM p
"""


def _op10_sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    t = license_tfidf
    templates = ", ".join(f"({text(template)}, {text(name)}, {title}, {text(term)}, {n})" for template, name, title, term, n in t.template_terms())
    blank, comments, term = (text(x) for x in (t.BLANK_LINE, t.COMMENTS, t.TERM))
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(source || '/', '') || coalesce(lang || '/', '') AS above, rtrim(coalesce(source || '/', '') || coalesce(lang || '/', ''), '/') AS dir, coalesce(text, '') AS text FROM documents),
tpl(template, license, title, term, tf) AS (VALUES {templates}),
parts AS (
  SELECT doc_id, [text] || list_filter(regexp_split_to_array(text, {blank}), lambda x: regexp_matches(x, '\\S')) || regexp_extract_all(text, {comments}) || list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS us FROM d),
u AS (SELECT doc_id, unit - 1 AS unit, regexp_extract_all(lower(u), {term}) AS terms FROM (SELECT doc_id, unnest(range(1, len(us) + 1)) AS unit, unnest(us) AS u FROM parts)),
hit AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest(terms) AS term FROM u) WHERE term IN (SELECT term FROM tpl) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, count(*) AS n FROM hit WHERE unit = 0 GROUP BY 1 UNION ALL SELECT term, count(DISTINCT template) FROM tpl GROUP BY 1) GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents) + (SELECT count(DISTINCT template) FROM tpl))::DOUBLE / (1 + df)) + 1 AS idf FROM df),
weight AS (SELECT template, license, title, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY template)) AS share FROM tpl JOIN idf USING (term)),
norm AS (SELECT doc_id, unit, sum(((1 + ln(tf)) * idf) ** 2) AS known, sum(tf) AS n_known FROM hit JOIN idf USING (term) GROUP BY ALL),
dot AS (SELECT doc_id, unit, template, license, title, sum((1 + ln(tf)) * idf * share) AS dot FROM hit JOIN idf USING (term) JOIN weight USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, unit, license, title, n_known >= {t.SHARE} * len(terms) AS known_text, round(dot / sqrt(known + (len(terms) - n_known)), {t.PLACES}) AS cosine FROM dot JOIN norm USING (doc_id, unit) JOIN u USING (doc_id, unit)),
enough AS (SELECT * FROM scored WHERE cosine >= {t.LEAST}),
best AS (SELECT DISTINCT ON (doc_id) doc_id, license, cosine FROM enough ORDER BY doc_id, license = {text(t.LAST)}, cosine DESC, license),
filed AS (
  SELECT s.doc_id, bool_or(unit = 0 AND s.cosine >= {t.FILE_LEAST}) AS whole, bool_or(title AND unit = 1 AND s.cosine >= {t.TITLE_LEAST}) AS headed
  FROM enough s JOIN best USING (doc_id, license) GROUP BY 1),
told AS (
  SELECT d.doc_id, dir, license, cosine, coalesce(whole OR (headed AND (SELECT bool_or(known_text) FROM scored k WHERE k.doc_id = d.doc_id AND unit = 0)), false) AS license_file
  FROM d LEFT JOIN best USING (doc_id) LEFT JOIN filed USING (doc_id)),
given AS (SELECT DISTINCT ON (dir) dir, license FROM told WHERE license_file ORDER BY dir, cosine DESC, license),
near AS (
  SELECT DISTINCT ON (a.dir) a.dir, g.license AS inherited
  FROM (SELECT DISTINCT dir FROM told) a JOIN given g ON g.dir = a.dir OR g.dir = '' OR starts_with(a.dir, g.dir || '/') ORDER BY a.dir, length(g.dir) DESC)
SELECT doc_id, license, cosine, license_file, inherited, CASE WHEN license IS NOT NULL THEN 'notice' WHEN inherited IS NOT NULL THEN 'directory' END AS license_from
FROM told LEFT JOIN near USING (dir)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fm_decontam": op1_fm_decontam, "op2_pii_boost": op2_pii_boost, "op3_es_mix": op3_es_mix, "op4_nb_toxic": op4_nb_toxic, "op5_mil_quality": op5_mil_quality, "op6_popcount_simhash": op6_popcount_simhash, "op7_exthash_dedup": op7_exthash_dedup, "op8_token_prefix": op8_token_prefix, "op9_secret_markov": op9_secret_markov, "op10_license_tfidf": op10_license_tfidf}


def oracle_sql() -> dict[str, str]:
    return {"op1_fm_decontam": OP1_SQL, "op3_es_mix": OP3_SQL, "op7_exthash_dedup": OP7_SQL, "op10_license_tfidf": _op10_sql()}
