"""One query per operator over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridemetrics.llm.embedding_dedup import embedding_dedup
from ridemetrics.llm.exact_dedup import exact_dedup
from ridemetrics.llm.line_dedup import CHUNKINGS, UNION_EVERY, line_dedup
from ridemetrics.llm.lloyd import CLUSTERS, DIMS, ROUNDS, lloyd_clusters
from ridemetrics.llm.lm_scoring import lm_scores
from ridemetrics.llm.mixing import mix_sources
from ridemetrics.llm.packing import pack_documents
from ridemetrics.llm.prefix_trie import prefix_trie
from ridemetrics.llm.quality import quality_scores
from ridemetrics.llm.simhash import simhash_components
from ridemetrics.llm.substring_dedup import substring_dedup
from ridemetrics.llm.suffix_dedup import suffix_dedup
from ridemetrics.llm.token_records import record_digests, write_records
from ridemetrics.session import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup(docs, every=UNION_EVERY, chunkings=CHUNKINGS).drop("kept_text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_table(spark, sf_dir, "documents"), path)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-records")
    write_records(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return record_digests(spark, path)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_clusters(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_records": op11_token_records,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lloyd": op13_lloyd,
}


def _lloyd_sql(dims: int, clusters: int, rounds: int) -> str:
    """The rounds of op13 written out one after the other."""
    steps = [
        f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::double[], lambda x: floor(1024 * x)::bigint) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        dims AS (SELECT unnest(range(1, {dims + 1})) AS j),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c
            FROM kept ORDER BY k LIMIT {clusters}
        )"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
            SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{
                'd': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'k': k
            }}) AS best
            FROM kept, c{i} GROUP BY row
        )""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (
            SELECT k, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY j) AS c
            FROM (SELECT best.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, dims GROUP BY ALL) GROUP BY k
        ),
        c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, best.k::int AS cluster, best.d AS distance,
               (sum(best.d) OVER (PARTITION BY best.k))::bigint AS cluster_inertia,
               (sum(best.d) OVER ())::bigint AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON k = best.k
    """


ORACLE = {
    "op8_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        groups AS (
            SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
        FROM texts JOIN groups USING (text)
    """,
    "op1_suffix_dedup": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (
            SELECT doc_id, unnest(range(greatest(len(h) // 2 - 99, 0))) AS i, h FROM docs
        ),
        windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM starts),
        again AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows
            ) WHERE nth > 1
        ),
        runs AS (
            SELECT doc_id, i, i + 100 AS stop,
                   max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM again
        ),
        numbered AS (
            SELECT *, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM runs
        ),
        spans AS (SELECT doc_id, run, min(i) AS a, max(stop) AS b FROM numbered GROUP BY doc_id, run),
        gaps AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
            UNION ALL
            SELECT d.doc_id, coalesce(max(s.b), 0), len(any_value(h)) // 2
            FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
        ),
        kept AS (
            SELECT g.doc_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h
            FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id
        )
        SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(s.n, 0)::bigint AS n_removed, coalesce(s.spans, 0) AS n_spans,
               sha256(unhex(k.h)) AS kept_sha256
        FROM docs d JOIN kept k ON k.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id
    """,
    "op5_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM docs)
        ),
        again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
        ),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(35)) AS j)),
        words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM docs),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::double[] AS e, sqrt(list_inner_product(embedding::double[], embedding::double[])) AS norm
            FROM embeddings WHERE embedding IS NOT NULL
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a, vectors b
            WHERE a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
              AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
        ),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ),
        least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) c USING (vec_id)
    """,
    # crc32 by its polynomial, a bit at a time.
    "op12_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, role, text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)
            ) AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
            WHERE conv_id IS NOT NULL
        ),
        convs AS (
            SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
                list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint),
                lambda crc, byte: list_reduce(
                    range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384), xor(crc, byte)
                ),
                4294967295::bigint
            )) % 4 AS h
            FROM turns
        ),
        rebuilt AS (
            SELECT c, pos, role, text FROM convs JOIN turns ON conv_id = base AND pos <= h
            UNION ALL
            SELECT c, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos > h
        ),
        paths AS (
            SELECT c, coalesce(seq, []) AS seq FROM convs
            LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS seq FROM rebuilt GROUP BY c) USING (c)
        ),
        nodes AS (
            SELECT d, path, min(c) AS conv_id, count(*) AS n_convs,
                   string_agg(c::varchar, ',' ORDER BY c) FILTER (len(seq) = d) AS ends
            FROM (SELECT c, seq, d, seq[1:d] AS path FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM paths))
            GROUP BY d, path
        ),
        linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id, (
                SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.path[1:n.d] = n.path
            ) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
        ),
        below AS (
            SELECT a, path[1:a] AS path, n_children = 0 AS leaf,
                   CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
            FROM (SELECT *, unnest(range(d + 1)) AS a FROM linked)
        ),
        subtree AS (
            SELECT a AS d, path, count(*) FILTER (leaf) AS n_leaves, sum(saved)::bigint AS saved_tokens FROM below GROUP BY a, path
        )
        SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
               sha256(coalesce(ends, '')) AS ends_sha256
        FROM linked JOIN subtree USING (d, path)
    """,
    "op13_lloyd": _lloyd_sql(DIMS, CLUSTERS, ROUNDS),
}
