"""The ten operations and the pipeline as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplan.llm import arrow_tokens, bpe, html_tree, iblt, language_id, line_templates, mixing, near_dedup, quality_knn, scratch, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(column: str, parts: int):
    """The part, by crc32 of the id as text, that a row belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.deduplicated(docs, min_docs=3, min_tokens=3).select("doc_id", "n_lines", "n_dropped", "text")


def op2_family_svm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(part_of("doc_id", 3) == 1, F.lit(False)))
    model = language_id.learn(docs.filter("NOT held_out").select("doc_id", "text", "lang"))
    return language_id.identified(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op4_latent_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(part_of("doc_id", 4) != 2, F.lit(False)))
    scored = quality_knn.scored(docs, quality_knn.learn(docs, labels))
    held = F.coalesce(part_of("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "tokens")
    manifest = arrow_tokens.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)
    return arrow_tokens.documents(manifest)


def op6_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op8_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_tiktoken_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * weight, cap) AS target,
         ('0x' || substr(md5(CASE WHEN source IS NULL THEN '9:null' ELSE '9:s:' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * size AS taken
FROM r
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), r AS (
  SELECT doc_id, doc_id AS m FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m
), c AS (
  SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.m
), c AS (
  SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.component_id = c.vec_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), u AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM d
), f AS (
  SELECT doc_id, i, regexp_replace(trim(regexp_replace(l, '[\x09-\x0D ]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM u
), t AS (
  SELECT *, string_split(m, ' ') AS ts FROM f
), g AS (
  SELECT doc_id, i, m, ts, len(ts)::VARCHAR || ' ' || array_to_string(ts[1:3], ' ') AS leaf FROM t WHERE len(ts) >= 3
), forms AS (
  SELECT m, any_value(ts) AS ts, any_value(leaf) AS leaf, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM g GROUP BY m
), pending AS (
  SELECT * FROM forms WHERE leaf IN (SELECT leaf FROM forms GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 3)
), tokens AS (
  SELECT m, leaf, docs, unnest(range(1, len(ts) + 1)) AS pos, unnest(ts) AS token FROM pending
), counted AS (
  SELECT *, sum(docs) OVER (PARTITION BY leaf, pos, token) AS c FROM tokens
), own AS (
  SELECT m, leaf, string_agg(CASE WHEN c >= 3 THEN token ELSE chr(1) END, ' ' ORDER BY pos) AS template, count(*) FILTER (c >= 3) / count(*)::DOUBLE AS share
  FROM counted GROUP BY m, leaf
), named AS (
  SELECT forms.m, docs, first, CASE WHEN share >= 0.7 THEN 't ' || own.leaf || chr(2) || template ELSE 'm ' || forms.m END AS tid
  FROM forms LEFT JOIN own ON own.m = forms.m
), grouped AS (
  SELECT tid, sum(docs) AS docs, min(first) AS first FROM named GROUP BY tid
), recurring AS (
  SELECT m, grouped.first FROM named JOIN grouped USING (tid) WHERE grouped.docs >= 3
), drops AS (
  SELECT g.doc_id, list(g.i) AS dropped FROM g JOIN recurring r ON r.m = g.m WHERE g.doc_id <> r.first GROUP BY g.doc_id
)
SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(dropped), 0) AS n_dropped,
       CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda l, i: NOT list_contains(dropped, i)), chr(10)) END AS text
FROM d LEFT JOIN drops USING (doc_id)
"""

QUERIES = {
    "op1_line_templates": op1_line_templates,
    "op2_family_svm_language": op2_family_svm_language,
    "op3_chosen_path_dedup": op3_chosen_path_dedup,
    "op4_latent_knn_quality": op4_latent_knn_quality,
    "op5_arrow_tokens": op5_arrow_tokens,
    "op6_dom_sum_product": op6_dom_sum_product,
    "op7_iblt_fingerprints": op7_iblt_fingerprints,
    "op8_sorted_projection_dedup": op8_sorted_projection_dedup,
    "op9_systematic_mix": op9_systematic_mix,
    "op10_tiktoken_bpe": op10_tiktoken_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op1_line_templates": OP1_SQL, "op3_chosen_path_dedup": OP3_SQL, "op8_sorted_projection_dedup": OP8_SQL, "op9_systematic_mix": OP9_SQL}
