"""One query for each operator of this package, over whole tables, with production parameters; and DuckDB SQL for
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import alignment, decontam, langid, linededup, merkle, packing, pii, quality, simhash, tokens, topk, toxicity, warc
from tracemill.llm.base import id_remainder, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang_pred is the best learned language; `reliable` tells whether its score reaches the calibrated threshold."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs, where=~out)
    read = docs.select("doc_id", out.alias("held_out"), langid.identify(model, spark, reject=False)(F.col("text")).alias("p"))
    return read.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.reliable").alias("reliable"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), tokens.token_count(vocabulary())(F.col("text")).alias("n_tokens"))
    return read.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pii.digest()(F.col("text")).alias("p")).select("doc_id", "p.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return read.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, where=~held_out)
    read = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(model, spark)(F.col("text")).alias("score"))
    return read.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality, op3_warc, op4_token_counts, op5_pii, op6_simhash, op7_packing, op8_toxicity, op9_exact_top_k, op10_decontamination,
        op11_line_dedup, op12_merkle_manifest, op13_token_alignment)
}

ORACLE_SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(p.h, 5 * (k // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) % 32 AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to,
            CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN NULL ELSE true END AS digest_ok
        FROM p JOIN g USING (h)""",
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT r, doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
        j AS (SELECT k.*, last IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS gone FROM k LEFT JOIN f USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r""",
    "op12_merkle_manifest": """
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc),
        d AS (SELECT *, row_number() OVER () AS r, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 7 = 0 AS tampered FROM documents, t),
        f AS (SELECT r, doc_id, lang, CAST(n_chars + CAST(coalesce(tampered, false) AS HUGEINT) AS VARCHAR) AS more,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
        g AS (SELECT r, doc_id, coalesce('=' || lang, '') AS tree, sha256(head || chars || tail) AS leaf, sha256(head || coalesce(strlen(more) || ':' || more, '-') || tail) AS again FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM g),
        up(tree, l, i, n, h) AS (SELECT tree, 0, i, n, leaf FROM n
            UNION ALL SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, l, i // 2, n),
        s AS (SELECT tree, l AS height, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        top(l, i, n, h) AS (SELECT 0, i, n, h FROM s UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 2, n),
        w(r, tree, l, i, n, proof, fold) AS (SELECT r, tree, 0, i, n, '', again FROM n
            UNION ALL SELECT w.r, w.tree, w.l + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(h, ''), sha256(CASE WHEN w.i % 2 = 0 THEN fold || coalesce(h, '') ELSE h || fold END)
                FROM w LEFT JOIN up u ON u.tree = w.tree AND u.l = w.l AND u.i = xor(w.i, 1) WHERE w.n > 1),
        v(r, l, i, n, proof, fold) AS (SELECT w.r, 0, s.i, s.n, proof, fold FROM w JOIN s USING (tree) WHERE w.n = 1
            UNION ALL SELECT v.r, v.l + 1, v.i // 2, (v.n + 1) // 2, proof || coalesce(h, ''), sha256(CASE WHEN v.i % 2 = 0 THEN fold || coalesce(h, '') ELSE h || fold END)
                FROM v LEFT JOIN top u ON u.l = v.l AND u.i = xor(v.i, 1) WHERE v.n > 1)
        SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM v JOIN n USING (r) JOIN s USING (tree), (SELECT h AS root FROM top WHERE n = 1) WHERE v.n = 1""",
    "op10_decontamination": r"""
        WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents
            UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
        s AS (SELECT DISTINCT side, id, array_to_string(t[k:k + 4], ' ') AS g FROM (SELECT side, id, t, unnest(range(1, len(t) - 3)) AS k FROM w WHERE len(t) >= 5)),
        q AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, any_value(q.n) AS item_shingles, count(*) AS matched, count(*) / any_value(q.n) AS containment
        FROM s i JOIN s d ON i.g = d.g AND i.side = 'i' AND d.side = 'd' JOIN q ON q.id = i.id
        GROUP BY ALL HAVING count(*) >= 0.8 * any_value(q.n) - 1e-9""",
}
