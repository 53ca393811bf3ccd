"""Registered queries over the given tables, with the SQL that answers the same question if there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, bpe, chunk_bpe, mixing, pii, prefix_trie, recipes, simhash, sketch, substrings, toxicity, unigram, url_filters
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


#: The stated rules of op1, as (host, path, verdict).
URL_RULES = [
    url_filters.Rule("net", "/", "block"),
    url_filters.Rule("example.net", "/en/", "allow"),
    url_filters.Rule("example.com", "/de/", "block"),
    url_filters.Rule("org", "/fr/", "allow"),
]


@query("op1_url_filters")
def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    mined = url_filters.mine(url_filters.label_pages(pages, table(spark, sf_dir, "labels")))
    return url_filters.judge(pages, URL_RULES, mined)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return bpe.encoded_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op6_exact_dedup",
    r"""
    WITH texts AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
    FROM texts WINDOW same AS (PARTITION BY norm)
    """,
)
def op6_exact_dedup(spark, sf_dir):
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


def quality_weights(labels):
    """Quality weights of labelled documents: 2 for quality 1, 0.5 for quality 0 (1 without a label)."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return labels.select("doc_id", weight.alias("weight")).where("weight is not null")


@query(
    "op7_mixing",
    r"""
    WITH quality AS (
      SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS weight
      FROM labels GROUP BY doc_id
    ), sized AS (
      SELECT d.doc_id, d.source,
             len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || md5(coalesce(d.text, ''))), 1, 12))::BIGINT
                  ::DOUBLE + 0.5) / 281474976710656.0) / coalesce(q.weight, 1.0) AS key
      FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id
    ), per AS (
      SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE
                  ELSE 2.0::DOUBLE END AS weight
      FROM sized GROUP BY source
    ), levels AS (
      SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM per
    ), final AS (
      SELECT max(level) FILTER (WHERE level * weight <= cap) AS level FROM levels
    ), targets AS (
      SELECT l.source, l.source_size, least(l.weight * coalesce(f.level, 'inf'::DOUBLE), l.cap) AS target
      FROM levels l, final f
    ), plan AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
    ), ordered AS (
      SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs,
             round(p.target - p.epochs * p.source_size)::BIGINT AS budget,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size
                               ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS before
      FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
    )
    SELECT doc_id, size, source_size, target,
           epochs * size + greatest(0, least(size, budget - before))::BIGINT AS taken
    FROM ordered
    """,
)
def op7_mixing(spark, sf_dir):
    weights = quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), weights)
    taken = F.col("epochs") * F.col("size") + F.col("rest")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    return sketch.fingerprints_and_edits(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_pii")
def op10_pii(spark, sf_dir):
    return pii.personal_values(table(spark, sf_dir, "documents"))


@query("op11_chunk_bpe")
def op11_chunk_bpe(spark, sf_dir):
    encoded = chunk_bpe.encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        digests=True,
    )
    return encoded.withColumnRenamed("id", "doc_id")


@query(
    "op12_prefix_trie",
    r"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), turns AS (
      SELECT conv_id, len(role)::VARCHAR || ':' || role || text AS said,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role)::VARCHAR || ':' || role || text)) AS n
      FROM said
    ), ids AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                   lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                 lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM turns)
    ), bases AS (
      SELECT conv_id AS base, count(*) AS base_turns FROM turns GROUP BY conv_id
    ), rebuilt AS (
      SELECT i.conv_id, t.n AS depth, said, words FROM ids i JOIN turns t ON t.conv_id = i.base AND t.n <= i.h
      UNION ALL
      SELECT i.conv_id, t.n - i.h + least(i.h, coalesce(b.base_turns, 0)), said, words
      FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.n > i.h LEFT JOIN bases b ON b.base = i.base
    ), paths AS (
      SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS words FROM ids
      UNION ALL
      SELECT conv_id, depth::BIGINT, string_agg(md5(said), '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM rebuilt
    ), nodes AS (
      SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY path, depth
    ), ending AS (
      SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) JOIN paths USING (conv_id, depth) GROUP BY path
    ), below AS (
      SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
    ), sized AS (
      SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below USING (path)
    ), subtrees AS (
      SELECT left(path, 32 * up) AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM sized) GROUP BY 1
    )
    SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens,
           sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM sized s JOIN subtrees USING (path) LEFT JOIN ending e USING (path)
    LEFT JOIN nodes p ON s.depth > 0 AND p.path = left(s.path, 32 * (s.depth - 1))
    """,
)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    counted = alignment.alignment_counts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return counted.withColumnRenamed("id", "doc_id")
