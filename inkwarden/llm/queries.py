"""The training-data operators over the driver's tables, one query for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, collocations, dedup, jaccard, langid, license, mixing, packing, quality, search, sketches, suffix_dedup, toxicity
from .common import boxed, cut_lineage, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter(search.every_nth()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digested(suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = cut_lineage(mixing.measured(docs, boxed(docs, "doc_id")))
    return mixing.mix(rows).select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_repeats") * F.col("_size") + F.col("_extra")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, table(spark, sf_dir, "labels"), boxed(docs, "doc_id")).select("_row.doc_id", "doc_logit", "host_rate", "path_rate", "score", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digested(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_copies(table(spark, sf_dir, "documents"), size=4, num=80, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_topk_search": op2_topk_search,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_minhash_dedup": op13_minhash_dedup,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, '')) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, k % 3 + 1 AS w, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
      FROM w WINDOW before AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM l),
g AS (SELECT *, least(cap, floor(target + 0.5)::BIGINT) AS goal FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS reps FROM g),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.reps, p.goal - p.reps * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (reps * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda k: struct_pack(x := w[k], y := w[k + 1], z := w[k + 2]))) AS t FROM w),
g AS (SELECT lang, t.x AS x, t.y AS y, t.z AS z FROM t),
f1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
o AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c2 AS (SELECT f2.lang, x || ' ' || y AS phrase, f2.f AS a, p.f AS l, q.f AS r FROM f2
       JOIN f1 p USING (lang, x) JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y LEFT JOIN o USING (lang, x, y) WHERE most IS NULL OR 100 * most < 50 * f2.f),
c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, p.f AS fx, h.f AS fxy, t.f AS fyz, q.f AS fz FROM f3
       JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z
       JOIN f2 h ON h.lang = f3.lang AND h.x = f3.x AND h.y = f3.y JOIN f2 t ON t.lang = f3.lang AND t.x = f3.y AND t.y = f3.z),
s AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c2
      UNION ALL SELECT lang, phrase, a, c.l, c.r, c.score FROM (SELECT lang, phrase, a, least(
          struct_pack(score := (1000000::HUGEINT * a * a // (fx::HUGEINT * fyz))::BIGINT, k := 1, l := fx, r := fyz),
          struct_pack(score := (1000000::HUGEINT * a * a // (fxy::HUGEINT * fz))::BIGINT, k := 2, l := fxy, r := fz)) AS c FROM c3)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000""",
}
