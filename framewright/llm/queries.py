"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, language_id, language_model, ngram_join, quality, sharding, substring_dedup, toxicity
from .common import fold, read

SHARDS, SHARD_SEED = 40, 17


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = language_id.fit(docs.where(~F.col("held_out")))
    found = language_id.predict(docs, model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARDS, SHARD_SEED).drop("source", "fraction")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 4) != 2, F.lit(True))))
    return quality.score(docs, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 3) != 1, F.lit(True))))
    return toxicity.score(docs, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_sharding, op4_substring_dedup, op5_language_model, op6_bpe, op7_quality, op8_embedding_dedup, op9_toxicity, op10_decontamination)}


_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')"

#: Links to the smallest id that they reach: (a, b) both ways in edges, all ids in nodes (id).
_REACH = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"

ORACLES = {
    "op1_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
one AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), nodes AS (SELECT doc_id AS id FROM sets),
{_REACH} SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least ON doc_id = id""",
    "op4_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
windows AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS g FROM starts),
owners AS (SELECT g, min(doc_id) AS owner FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM windows JOIN owners USING (g), range(50) t(k) WHERE owner < doc_id),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), nodes AS (SELECT vec_id AS id FROM v), links AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a),
{_REACH} SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON vec_id = least.id LEFT JOIN links ON vec_id = links.id""",
    # every passage (step words and the next step) of every text with every item, without an index
    "op10_decontamination": f"""WITH items AS (SELECT item_id, w FROM (SELECT item_id, {_LOWER} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean, max(len(w)) AS step FROM items),
tf AS (SELECT item_id, t, size, count(*) AS f FROM (SELECT item_id, len(w) AS size, unnest(w) AS t FROM items) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT item_id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) AS x FROM tf JOIN df USING (t), st),
whole AS (SELECT item_id, sum(x) AS s FROM weights GROUP BY item_id),
docs AS (SELECT doc_id, row_number() OVER () AS d, {_LOWER} AS w FROM documents),
places AS (SELECT d, t, (i - 1) // step AS p FROM (SELECT d, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM docs), st),
terms AS (SELECT d, p, t FROM places UNION SELECT d, p - 1, t FROM places WHERE p > 0),
scored AS (SELECT d, p, item_id, sum(x) / any_value(s) AS score FROM terms JOIN weights USING (t) JOIN whole USING (item_id) GROUP BY d, p, item_id HAVING sum(x) / any_value(s) >= 0.7 - 1e-9),
cuts AS (SELECT item_id, w, coalesce(list_max(list_filter(range(1, len(w)), lambda j: regexp_matches(w[j], '[.?!]$'))), 0) AS c FROM items),
parts AS (SELECT item_id, 0 AS part, CASE WHEN c > 0 THEN w[1:c] ELSE w END AS v FROM cuts UNION ALL SELECT item_id, 1, w[c + 1:] FROM cuts),
grams AS (SELECT item_id, part, least(3, len(v)) AS size, list_distinct(list_transform(range(1, len(v) - least(3, len(v)) + 2), lambda j: array_to_string(v[j:j + least(3, len(v)) - 1], ' '))) AS g FROM parts),
passages AS (SELECT d, p, doc_id, item_id, score, w[p * step + 1:(p + 2) * step] AS v FROM scored JOIN docs USING (d), st),
shares AS (SELECT d, p, doc_id, item_id, score, part, len(list_intersect(g, list_transform(range(1, len(v) - size + 2), lambda j: array_to_string(v[j:j + size - 1], ' ')))) / len(g) AS share FROM passages JOIN grams USING (item_id)),
held AS (SELECT d, p, doc_id, item_id, score, max(share) FILTER (WHERE part = 0) AS q, max(share) FILTER (WHERE part = 1) AS a FROM shares GROUP BY d, p, doc_id, item_id, score HAVING min(share) >= 0.6),
best AS (SELECT d, doc_id, item_id, max(struct_pack(s := score, q := q, a := a)) AS b FROM held GROUP BY d, doc_id, item_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, round(b.s, 6) AS score, round(b.q, 6) AS question_overlap, round(b.a, 6) AS answer_overlap FROM best""",
}


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the others are held against brute force, libraries or held-out labels in tests/llm."""
    return dict(ORACLES)
