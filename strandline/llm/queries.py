"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.filter_audit import audit_documents
from strandline.llm.hmm_lm import train_and_score
from strandline.llm.kneser_ney import score_quality
from strandline.llm.line_dedup import line_report
from strandline.llm.mixing import mixed_counts
from strandline.llm.packing import pack_power_of_two
from strandline.llm.pii import KINDS, find_pii
from strandline.llm.prefix_trie import spliced_trie
from strandline.llm.simhash import simhash_groups
from strandline.llm.token_fst import token_counts
from strandline.llm.topk import exact_top_k
from strandline.llm.toxicity import remainder, score, train

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0).drop("scored_share")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder(F.col("doc_id"), 5) == 0
    weights, bias = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed=~held_out)
    rows = score(docs, weights, bias)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending", "worst_start", "worst_end")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_power_of_two(documents(spark, sf_dir), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = remainder(F.col("doc_id"), 7) != 2
    rows = train_and_score(documents(spark, sf_dir), trains)
    return rows.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(documents(spark, sf_dir))
    return rows.select("doc_id", *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key", "parent")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_exact_top_k, op3_simhash_near_dedup, op4_toxicity, op5_packing, op6_mixing, op7_lm_scoring, op8_pii, op9_exact_dedup, op10_quality_classifier, op11_prefix_trie, op12_filter_audit, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": """
            WITH v AS (SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
                       FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
            SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
            WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
        "op9_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
            FROM d""",
        # CRC-32 bit by bit: a character is mixed in, then -1 stands for each of eight shifts.
        "op11_prefix_trie": r"""
            WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
                       FROM conversations WHERE conv_id IS NOT NULL),
            b AS (SELECT c, list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))) AS l
                  FROM (SELECT DISTINCT c FROM t)),
            i AS (SELECT c, xor(list_reduce(l, lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM b),
            r AS (SELECT i.c, p, role, text FROM i JOIN t ON t.c = i.c - i.c % 20 AND p <= h UNION ALL SELECT t.c, p, role, text FROM t JOIN i ON t.c = i.c WHERE p > h),
            s AS (SELECT i.c, coalesce(list({'r': role, 't': text} ORDER BY p) FILTER (p IS NOT NULL), []) AS path FROM i LEFT JOIN r ON r.c = i.c GROUP BY i.c),
            m AS (SELECT c, d, path[1:d] AS node, len(path) = d AS at_end FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM s)),
            n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (at_end) AS ends FROM m GROUP BY node, d),
            k AS (SELECT node[1:d - 1] AS parent, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
            v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
                         CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(node[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
                  FROM n LEFT JOIN k ON k.d = n.d AND k.parent = n.node),
            u AS (SELECT a.node, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved FROM v a JOIN v b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY a.node, a.d)
            SELECT v.conv_id, v.d AS depth, w.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
                   sha256(coalesce(v.ends, '')) AS ends_sha256
            FROM v JOIN u ON u.d = v.d AND u.node = v.node LEFT JOIN v w ON w.d = v.d - 1 AND w.node = v.node[1:v.d - 1]""",
        "op12_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
            m AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
            l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < m.doc_id THEN 16 ELSE 0 END AS fails
                  FROM m LEFT JOIN l ON m.doc_id = l.doc_id),
            c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
            x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
            o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
                  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
            s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
                  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
            r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept,
                         coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
                         coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
                         coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
                         coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost,
                         coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost
                  FROM c, s GROUP BY part, filter_order, step, bit)
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
                   CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
                   CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
            FROM r""",
    }
