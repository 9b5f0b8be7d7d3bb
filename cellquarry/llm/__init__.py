"""Operators for preparing training data; nothing else in the library imports them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import op5_decontamination
from .embedding_dedup import op3_embedding_near_dedup
from .language_id import op1_language_id
from .masked_lm import op9_masked_lm_score
from .ngram_join import op8_ngram_jaccard_join
from .secret_scan import op10_secret_scan
from .source_mix import op7_source_mix
from .toxicity import op6_toxicity
from .url_filter import op2_url_filter
from .warc import op4_warc

def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op2_url_filter` without what its models judge: host, path, rule and the rule's verdict."""
    judged = op2_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op7_source_mix` without what seeds decide: sizes and targets."""
    return op7_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_url_filter, op3_embedding_near_dedup, op4_warc, op5_decontamination, op6_toxicity, op7_source_mix, op8_ngram_jaccard_join, op9_masked_lm_score, op10_secret_scan, url_rules, source_targets)
}
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit
            FROM embeddings
        ), pairs AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.fit AND b.fit AND len(a.e) = len(b.e)
            WHERE CASE WHEN a.fit AND b.fit THEN list_cosine_similarity(a.e, b.e) >= 0.93 END
        ), reach AS (
            SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, p.w FROM reach r JOIN pairs p ON p.u = r.other
        )
        SELECT vec_id, CAST((SELECT count(*) FROM pairs WHERE u = vec_id) AS BIGINT) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
        FROM reach GROUP BY vec_id
    """,
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []) AS w FROM documents),
        s AS (
            SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM w
        ), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        joint AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY ALL),
        links AS (SELECT u, v FROM joint JOIN n nu ON nu.r = u JOIN n nv ON nv.r = v WHERE c / (nu.n + nv.n - c) >= 0.8),
        reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, links.v FROM reach JOIN links ON links.u = reach.other),
        classes AS (SELECT reach.r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.other GROUP BY reach.r)
        SELECT w.doc_id, class_id, CAST((SELECT count(*) FROM links WHERE u = w.r) AS BIGINT) AS n_links, w.doc_id = class_id AS kept FROM w JOIN classes USING (r)
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), h AS (
            SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN head <> page_id THEN head END AS refers_to
        FROM p LEFT JOIN h USING (payload_digest)
    """,
    "url_rules": r"""
        WITH h AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        l AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
        rules AS (SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
                  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) AS t(ruled, rule, name, begins)),
        fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
                FROM l JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, begins) GROUP BY page_id)
        SELECT page_id, host, path, rule, ruled FROM l LEFT JOIN fit USING (page_id)
    """,
    "source_targets": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT source, sum(size) AS n, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
        step AS (
            SELECT 0 AS k, source, n, w, false AS shut, (SELECT sum(n) FROM s) AS rest, (SELECT sum(w) FROM s WHERE n > 0) AS open_w, 0.0 AS target FROM s
            UNION ALL
            SELECT k + 1, source, n, w, shut2, rest - sum(CASE WHEN shut2 AND NOT shut THEN 3 * n ELSE 0 END) OVER (), sum(CASE WHEN NOT shut2 AND n > 0 THEN w ELSE 0 END) OVER (), CASE WHEN shut2 THEN 3.0 * n ELSE 0 END
            FROM (SELECT *, shut OR (n > 0 AND rest * w / open_w > 3 * n) AS shut2 FROM step) WHERE k < 60
        ), final AS (SELECT source, n, CASE WHEN shut THEN 3.0 * n WHEN n > 0 THEN rest * w / open_w ELSE 0.0 END AS target FROM step WHERE k = 60)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 4) AS target FROM d JOIN final ON d.source IS NOT DISTINCT FROM final.source
    """,
}
