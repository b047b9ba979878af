"""The registered queries of this subpackage, one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover_tree, hilbert, line_dedup, minhash, mixing, packing, ppm, quality, repair, substring, warc, whitening

#: Parameters of the queries.
VOCABULARY = "word_bpe_49k.json"
N_SHARDS = 40


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "soft_failed", "host_rejected")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.order(_table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.selectExpr("doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard", "cell", "rank")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(_table(spark, sf_dir, "conversations"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(_table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1, "op2_minhash": op2, "op3_bpe": op3, "op4_cover_tree": op4, "op5_ppm": op5,
    "op6_substring": op6, "op7_quality": op7, "op8_hilbert": op8, "op9_warc": op9, "op10_packing": op10,
    "op11_repair": op11, "op12_whitening": op12, "op13_mixing": op13,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COMPONENTS = """
reach(id, to_id) AS (
  SELECT id, id FROM ids
  UNION
  SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.to_id
),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
"""

OP2 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
ids AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = id
"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
ids AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS}
SELECT id AS vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM comp LEFT JOIN (SELECT a, count(*) AS k FROM edges GROUP BY a) ON a = id
"""

OP6 = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE x IN (SELECT x FROM s GROUP BY x HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t) u ANTI JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""

OP7 = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT doc_id, x FROM s GROUP BY ALL HAVING count(*) > 1) q ON q.doc_id = s.doc_id AND q.x = s.x),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS i FROM r) GROUP BY doc_id),
f AS (SELECT t.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
        100 * n_symbols > {quality.MAX_SYMBOL_PCT} * word_chars OR 100 * n_dup_lines > {quality.MAX_DUP_LINE_PCT} * n_lines AS soft_failed FROM f),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR soft_failed) AS bad FROM b GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS v FROM h),
p AS (SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, {quality.PRIOR_MIN}), {quality.PRIOR_MAX}) ELSE {quality.PRIOR_MAX} END AS weight FROM m),
z AS (SELECT source, (bad + mean * weight) / (n + weight) > {quality.HOST_LIMIT} AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_rejected AND soft_failed) AS kept,
       n_lines, soft_failed, host_rejected
FROM b JOIN z ON z.source IS NOT DISTINCT FROM b.source
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[sid % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w, {float(mixing.SHARE)}::DOUBLE * sum(s) OVER () AS budget FROM s),
o AS (SELECT *, row_number() OVER z AS place, coalesce(sum({mixing.PASSES} * s) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limited,
        sum(w) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW z AS (ORDER BY s / w, sid)),
v AS (SELECT (budget - limited) / open AS level FROM o WHERE (budget - limited) / open * w <= {mixing.PASSES} * s ORDER BY place LIMIT 1),
t AS (SELECT sid, source, s::BIGINT AS source_size, least({mixing.PASSES} * s, level * w) AS target, floor(budget) AS budget FROM o, v),
q AS (SELECT d.*, t.* EXCLUDE (source), row_number() OVER (PARTITION BY sid ORDER BY key) AS place, sum(size) OVER (PARTITION BY sid ORDER BY key ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
m AS (SELECT sid, place, pass, size, budget, sum(size) OVER (ORDER BY (pass * source_size + sent)::DOUBLE / target, sid, pass, key, place ROWS UNBOUNDED PRECEDING) AS total
      FROM q, range({mixing.PASSES}) p(pass) WHERE size > 0),
k AS (SELECT sid, place, sum(size) AS taken FROM m WHERE total <= budget GROUP BY sid, place)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (sid, place)
"""

#: Not expressible in SQL (checksums, tokenizers, archives, approximate cut points, edit scripts, eigenvectors): 1, 3, 5, 8, 9, 10, 11, 12; brute force in tests/llm.
ORACLES: dict[str, str] = {"op2_minhash": OP2, "op4_cover_tree": OP4, "op6_substring": OP6, "op7_quality": OP7, "op13_mixing": OP13}
