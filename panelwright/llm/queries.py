"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import (
    bpe, decontaminate, exact_dedup, lm_score, near_dup, pieces, pii, prefix_trie, quality, repeats, search, secrets,
    toxicity,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_pii(spark, folder):
    return pii.extract(_table(spark, folder, "documents"))


def op2_minhash_near_dup(spark, folder):
    return near_dup.near_duplicates(_table(spark, folder, "documents")).drop("text_key", "leads")


def op3_suffix_repeats(spark, folder):
    return repeats.repeated_passages(_table(spark, folder, "documents"))


def op4_decontamination(spark, folder):
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_byte_bpe(spark, folder):
    return bpe.round_trip(_table(spark, folder, "documents"))


def op6_secret_scan(spark, folder):
    return secrets.scan(_table(spark, folder, "documents"))


def op7_quality(spark, folder):
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_lm_score(spark, folder):
    return lm_score.score_words(_table(spark, folder, "documents"))


def op8_byte_lm_score(spark, folder):
    return lm_score.score(_table(spark, folder, "documents"))


def op9_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(_table(spark, folder, "documents")).drop("ties")


def op10_toxicity(spark, folder):
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_sentencepiece(spark, folder):
    return pieces.round_trip(_table(spark, folder, "documents"))


def op12_ranked_search(spark, folder):
    return search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_prefix_trie(spark, folder):
    return prefix_trie.trie(_table(spark, folder, "conversations"))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_minhash_near_dup, op3_suffix_repeats, op4_decontamination, op5_byte_bpe, op6_secret_scan,
        op7_quality, op8_lm_score, op8_byte_lm_score, op9_exact_dedup, op10_toxicity, op11_sentencepiece,
        op12_ranked_search, op13_prefix_trie, pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS4 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS8 = f"regexp_extract_all({_LOWER}, '[^\\x09-\\x0D\\x20]+')"

# DuckDB has no crc32: eight steps of its polynomial for each character of the decimal number.
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, b:
    list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, z:
        CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
        hits AS (SELECT r, s, n, item_id FROM grams JOIN windows USING (g, n)),
        marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN marked USING (r) LEFT JOIN items USING (r)""",
    "op8_byte_lm_score": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        x AS (SELECT r, '000000' || hex(encode(t)) AS h, octet_length(encode(t)) AS n FROM d),
        p AS (SELECT r, substr(h, 2 * i + 1, 8) AS g FROM (SELECT r, h, unnest(range(0, n)) AS i FROM x)),
        own AS (SELECT r, g, count(*) AS k FROM p GROUP BY r, g),
        c AS (SELECT g, sum(k) AS c4 FROM own GROUP BY g),
        t AS (
            SELECT g, c4, sum(c4) OVER (PARTITION BY substr(g, 3)) AS c3, sum(c4) OVER (PARTITION BY substr(g, 5)) AS c2,
                sum(c4) OVER (PARTITION BY substr(g, 7)) AS c1, sum(c4) OVER (PARTITION BY substr(g, 1, 6)) AS x4,
                sum(c4) OVER (PARTITION BY substr(g, 3, 4)) AS x3, sum(c4) OVER (PARTITION BY substr(g, 5, 2)) AS x2,
                sum(c4) OVER () AS x1
            FROM c),
        s AS (
            SELECT r, sum(k) AS n, sum(k * CASE
                WHEN c4 > k THEN ln((c4 - k) / (x4 - k))
                WHEN c3 > k THEN ln((c3 - k) / (x3 - k)) + ln(0.4)
                WHEN c2 > k THEN ln((c2 - k) / (x2 - k)) + 2 * ln(0.4)
                WHEN c1 > k THEN ln((c1 - k) / (x1 - k)) + 3 * ln(0.4)
                ELSE ln(1 / (x1 + 1)) END) AS score
            FROM own JOIN t USING (g) GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(coalesce(score, 0), 3) AS log_score,
            CASE WHEN n > 0 THEN round(score / n, 6) END AS mean_log_score
        FROM d LEFT JOIN s USING (r)""",
    "op8_lm_score": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS8} AS w FROM documents),
        p AS (
            SELECT r, l[i] AS w1, l[i + 1] AS w2, l[i + 2] AS w3
            FROM (SELECT r, list_concat(['', ''], w) AS l, unnest(range(1, len(w) + 1)) AS i FROM d)),
        own AS (SELECT r, w1, w2, w3, count(*) AS k3 FROM p GROUP BY r, w1, w2, w3),
        t AS (
            SELECT r, k3, sum(k3) OVER (PARTITION BY r, w2, w3) AS k2, sum(k3) OVER (PARTITION BY r, w3) AS k1,
                sum(k3) OVER (PARTITION BY r, w1, w2) AS o3, sum(k3) OVER (PARTITION BY r, w2) AS o2, sum(k3) OVER (PARTITION BY r) AS o1,
                sum(k3) OVER (PARTITION BY w1, w2, w3) AS c3, sum(k3) OVER (PARTITION BY w2, w3) AS c2,
                sum(k3) OVER (PARTITION BY w3) AS c1, sum(k3) OVER (PARTITION BY w1, w2) AS x3,
                sum(k3) OVER (PARTITION BY w2) AS x2, sum(k3) OVER () AS x1
            FROM own),
        s AS (
            SELECT r, sum(k3) AS n, sum(k3 * CASE
                WHEN c3 > k3 THEN ln((c3 - k3) / (x3 - o3))
                WHEN c2 > k2 THEN ln((c2 - k2) / (x2 - o2)) + ln(0.4)
                WHEN c1 > k1 THEN ln((c1 - k1) / (x1 - o1)) + 2 * ln(0.4)
                ELSE ln(1 / (x1 + 1)) END) AS score
            FROM t GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(coalesce(score, 0), 3) AS log_score,
            CASE WHEN n > 0 THEN round(score / n, 6) END AS mean_log_score
        FROM d LEFT JOIN s USING (r)""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
        c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
        p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
        f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
            FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
        b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS4} AS w FROM benchmark),
        q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS t FROM b) GROUP BY i, item_id, t),
        m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms AS m FROM d, c),
        s AS (
            SELECT i, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM o WHERE place <= 20""",
    "op13_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, sha256(octet_length(encode(r)) || ':' || r || x) AS h, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || x)) - 1 AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS skip FROM (SELECT DISTINCT conv_id FROM t)),
        b AS (
            SELECT c.conv_id, t.pos, t.h, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.skip
            UNION ALL SELECT c.conv_id, t.pos, t.h, t.words FROM c JOIN t USING (conv_id) WHERE t.pos >= c.skip),
        p AS (
            SELECT conv_id, words, row_number() OVER w AS depth, string_agg(h, '') OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        m AS (
            SELECT conv_id, depth, path, substr(path, 1, CAST(64 * (depth - 1) AS BIGINT)) AS above, words FROM p
            UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
        longest AS (SELECT conv_id, max(depth) AS size FROM m GROUP BY conv_id),
        n AS (
            SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
                (count(*) - 1) * any_value(words) AS gain,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
            FROM m JOIN longest USING (conv_id) GROUP BY path),
        k AS (SELECT above AS path, count(*) AS n_children FROM n GROUP BY above),
        v AS (
            SELECT m.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum(n.gain) AS saved
            FROM n LEFT JOIN k USING (path) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
            n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n LEFT JOIN n AS u ON u.path = n.above LEFT JOIN k ON k.path = n.path JOIN v ON v.path = n.path""",
}
