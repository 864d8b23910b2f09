"""The queries of this subpackage, one for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embed_dedup, fingerprints, html_extract, importance, langid, mixing, prefix_trie, sharding, simhash, token_counts, warc

#: Where the public vocabularies lie; a parameter of the operators, never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": _over("pages", html_extract.extract),
    "op2_warc_revisits": _over(
        "pages", lambda df: warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    ),
    "op3_multiset_fingerprints": _over("documents", fingerprints.fingerprints),
    "op4_language_id": _over("documents", langid.predicted),
    "op5_simhash_near_dedup": _over("documents", simhash.near_duplicates),
    "op6_chat_formatting": _over("conversations", chat.formatted_digests),
    "op7_bpe": _over("documents", lambda df: bpe.encoded(df, VOCABULARY, with_ids=False)),
    "op8_embedding_near_dedup": _over("embeddings", embed_dedup.near_duplicates),
    "op9_mixing": _over("documents", mixing.mixed),
    "op10_sharding": _over("documents", sharding.sharded),
    "op11_importance_resampling": lambda spark, sf_dir: importance.resampled(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ),
    "op12_token_counts": _over("documents", lambda df: token_counts.counted(df, PIECES)),
    "op13_prefix_trie": _over("conversations", prefix_trie.trie),
}

_BASE32 = "||".join(f"to_base(CAST('0x' || substr(x, {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8))
_ESCAPES = "\\\\\\\\|" + "|".join(x.replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for x in chat.CONTROLS)
_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '" + _ESCAPES.replace("\\\\\\\\", "\\\\") + "'))"
_T = chat.Template()

# the public CRC-32 from a string's bytes, over a table made by its polynomial
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n)))"""
_CRC = """xor(list_reduce([4294967295] || list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FEATURES = f"""SELECT k, count(*) OVER (PARTITION BY k) AS n, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]
    || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f
    FROM (SELECT {{0}} AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_WORD}') AS w FROM {{1}})"""

ORACLE: dict[str, str] = {
    "op11_importance_resampling": f"""
        WITH {_CRC_TABLE}, d AS ({_FEATURES.format("doc_id", "documents")}), b AS ({_FEATURES.format("item_id", "benchmark")}),
        u AS (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b)), h AS (SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM u, crc),
        s AS (SELECT bucket, count(*) AS s FROM d JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (f) GROUP BY bucket),
        n AS (SELECT (SELECT count(*) FROM d) + 10000 AS s, (SELECT count(*) FROM b) + 10000 AS t),
        g AS (SELECT k.bucket, floor(1000 * ln(CAST((coalesce(t.t, 0) + 1) * n.s AS DOUBLE) / CAST((coalesce(s.s, 0) + 1) * n.t AS DOUBLE))) AS gain
              FROM range(10000) AS k(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
        w AS (SELECT k AS doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) GROUP BY k),
        c AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                     + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
              FROM documents LEFT JOIN w USING (doc_id)),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 57)
        SELECT c.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM c LEFT JOIN o USING (doc_id)""",
    "op13_prefix_trie": f"""
        WITH RECURSIVE {_CRC_TABLE},
        c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                     sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT DISTINCT conv_id FROM c), h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM k, crc),
        r AS (SELECT h.conv_id, 0 AS own, i, role, text FROM h JOIN c ON c.conv_id = h.base AND i <= h
              UNION ALL SELECT h.conv_id, 1, i, role, text FROM h JOIN c ON c.conv_id = h.conv_id AND i > h),
        e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, sha256(length(role) || ':' || role || text) AS x,
                     len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
        p AS (SELECT conv_id, 0 AS depth, '' AS key, CAST(NULL AS VARCHAR) AS parent, 0 AS words FROM h
              UNION ALL SELECT p.conv_id, e.depth, sha256(p.key || e.x), p.key, e.words FROM p JOIN e ON e.conv_id = p.conv_id AND e.depth = p.depth + 1),
        z AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
        n AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM z GROUP BY key),
        m AS (SELECT n.*, (SELECT count(*) FROM n AS q WHERE q.parent = n.key) AS n_children FROM n),
        a AS (SELECT key AS top, key, parent AS up FROM m UNION ALL SELECT q.key, a.key, q.parent FROM a JOIN m AS q ON q.key = a.up),
        s AS (SELECT top, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.words) AS BIGINT) AS saved_tokens
              FROM a JOIN m ON m.key = a.key GROUP BY top)
        SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN s ON s.top = m.key LEFT JOIN m AS q ON q.key = m.parent""",
    "op2_warc_revisits": f"""
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
        b AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
                     translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op6_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum({len(_T.open + _T.middle + _T.close)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
        c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n ON c.vec_id = n.a""",
}
