"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import divergence, embedding_dedup, exact_dedup, minhash_dedup, mixing, prefix_trie, quality, ring_sharding, sentencepiece_lattice, substring_dedup, token_codes, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_codes.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_codes.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of the text they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_lattice.decode(encoded, model)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def _remainder(of: int, value: int):
    """Whether the CRC-32 of an id's text leaves `value`; false for null."""
    return lambda doc_id: F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == value, F.lit(False))


toxic_held_out = _remainder(4, 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), _remainder(5, 0)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), held_out))
    return _predicted(scored, held_out)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxic_held_out))
    return _predicted(scored, toxic_held_out)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.assign(table(spark, sf_dir, "documents"))


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_minhash_dedup,
        op3_substring_dedup,
        op4_warc,
        op5_token_codes,
        op6_exact_dedup,
        op7_sentencepiece,
        op8_quality,
        op9_toxicity,
        op10_embedding_dedup,
        op11_prefix_trie,
        op12_divergence,
        op13_ring_sharding,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH rows AS (
            SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages
        ),
        ranked AS (
            SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS other FROM rows
        )
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
            CASE WHEN other = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            nullif(other, page_id) AS refers_to
        FROM ranked
    """,
    "op11_prefix_trie": r"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
                lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS entries
        ),
        turns AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
                sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS content
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS place FROM turns),
        counted AS (SELECT conv_id, max(place) AS n FROM placed GROUP BY conv_id),
        shared AS (
            SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
                [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]))) % 6 AS share
            FROM counted, crc
        ),
        convs AS (
            SELECT s.*, least(s.share, coalesce(b.n, 0)) AS head, least(s.share, coalesce(b.n, 0)) + greatest(s.n - s.share, 0) AS len
            FROM shared s LEFT JOIN counted b ON b.conv_id = s.base
        ),
        built AS (
            SELECT c.conv_id, c.len, p.place AS depth, p.content, p.chars FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.head
            UNION ALL
            SELECT c.conv_id, c.len, p.place - c.share + c.head, p.content, p.chars FROM convs c JOIN placed p USING (conv_id) WHERE p.place > c.share
        ),
        paths AS (
            SELECT conv_id, len, depth, chars, sha256(string_agg(content, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM built
            UNION ALL
            SELECT conv_id, len, 0, 0, '' FROM convs
        ),
        nodes AS (
            SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
            FROM paths GROUP BY node, depth
        ),
        edges AS (SELECT DISTINCT a.node AS parent, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
        kin AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        children AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent),
        sums AS (
            SELECT top AS node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
            FROM kin JOIN nodes n USING (node) LEFT JOIN children c USING (node) GROUP BY top
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
            s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN edges e ON e.node = n.node LEFT JOIN nodes p ON p.node = e.parent
    """,
    "op12_divergence": r"""
        WITH rows AS (
            SELECT doc_id, row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        found AS (
            SELECT row, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM rows
        ),
        counted AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
        kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 10),
        vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM rows),
        dense AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
        ),
        sums AS (
            SELECT lang, source, term, n, v, sum(n) OVER (PARTITION BY lang, source) AS own,
                sum(n) OVER (PARTITION BY lang, term) AS every, sum(n) OVER (PARTITION BY lang) AS whole
            FROM dense JOIN vocabulary USING (lang)
        ),
        shares AS (
            SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (own + 2 * v))::HUGEINT AS p,
                (1 + (1000000000::HUGEINT * (every + 2)) // (whole + 2 * v))::HUGEINT AS q
            FROM sums
        ),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
        )
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 10
    """,
    "op6_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents
        ),
        ranked AS (
            SELECT doc_id, content,
                first_value(doc_id) OVER (PARTITION BY content ORDER BY size DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY content) AS group_size
            FROM rows
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM ranked
    """,
}
