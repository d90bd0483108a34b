"""The queries of this package, one for each operator, with their production parameters; and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, mixing, near_dedup, packing, pii, secrets, sharding, topk, toxicity, trie, whitening
from .common import fold_of, read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth vector, the ten others with the largest integer inner products."""
    return topk.exact_top_k(spark, read_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts by base kind, a digest of the base spans, all spans and their number."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    base = pii.of_kinds(F.col("pii_spans"), pii.BASE)
    counts = [F.size(pii.of_kinds(F.col("pii_spans"), (k,))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    every = F.when(F.col("pii_spans") == "", 0).otherwise(F.size(F.split("pii_spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.col("pii_spans").alias("spans"), every)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families that every whole text names."""
    docs = read_table(spark, sf_dir, "documents")
    return licenses.scan_licenses(spark, docs, licenses.train_licenses(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that a source's share follows the square root of its size, in random order."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "text", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").cast("long").alias("copies"), F.col("mix_copy").cast("long").alias("copy"), F.col("mix_key").alias("order_key"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text; what is held out (fold 1 of 3) teaches nothing."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))
    scored = toxicity.score_toxicity(spark, docs, model)
    held = (fold_of(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fiftieth vector, the five nearest others that the posting lists find."""
    return ann.nearest(spark, read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: two-word shingles, similarity 0.8 or more."""
    return near_dedup.near_duplicates(spark, read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids by concatenating and cutting."""
    pieces = packing.pack(spark, read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes that cut few groups of equal texts."""
    placed = sharding.shard_documents(spark, read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; what is held out (fold 0 of 5) teaches nothing."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train_language_model(docs.where(fold_of(F.col("doc_id"), 5) != 0))
    held = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    return langid.identify_language(spark, docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector, by exact covariances of 256 times its entries."""
    found = whitening.whiten(spark, read_table(spark, sf_dir, "embeddings"), components=4, scale=256.0)
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt to start as the first of its hundred."""
    return trie.prefix_trie(spark, read_table(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts by base kind, a digest of the base spans, all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(spark, docs, secrets.train_secrets(docs)).select("doc_id", "secret_spans")
    base = pii.of_kinds(F.col("secret_spans"), secrets.BASE)
    counts = [F.size(pii.of_kinds(F.col("secret_spans"), (k,))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.col("secret_spans").alias("spans"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_neighbours": op6_neighbours,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
    "op11_whitening": op11_whitening,
    "op12_trie": op12_trie,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op4_mixing": """
        WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
        rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM counts),
        means AS (SELECT source, rate, greatest(1, ceil(rate / 8))::BIGINT AS parts, rate / greatest(1, ceil(rate / 8)) AS mean FROM rates),
        terms AS (SELECT source, k, exp(-mean) * product(CASE WHEN i = 0 THEN 1 ELSE mean / i END) AS term
                  FROM means, range(64) t(k), LATERAL (SELECT unnest(range(k + 1)) AS i) GROUP BY source, mean, k),
        cdf AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
        lists AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
        counted AS (
            SELECT d.doc_id, d.source, d.text, m.rate, list_sum(list_transform(range(m.parts), lambda j:
                       len(list_filter(l.cdf, lambda c: c <= ('0x' || md5(d.doc_id || ':' || j || ':17')[1:8])::BIGINT / 4294967296.0)))) AS copies
            FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
        SELECT doc_id, source, text, round(rate, 6) AS rate, copies::BIGINT AS copies, copy, md5('order:' || doc_id || ':' || copy || ':17') AS order_key
        FROM counted, LATERAL (SELECT unnest(range(1, copies::BIGINT + 1)) AS copy)""",
    "op7_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT doc_id, r, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        sizes AS (SELECT doc_id, r, len(s)::BIGINT AS n FROM sets),
        spread AS (SELECT r, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
        shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM spread a JOIN spread b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
        links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
        least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
        SELECT s.doc_id, s.n AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN least(s.doc_id, coalesce(l.m, s.doc_id)) END AS component_id, coalesce(s.doc_id = component_id, true) AS kept
        FROM sizes s LEFT JOIN least l USING (doc_id)""",
    "op12_trie": """
        WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
        heads AS (SELECT conv_id, (xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                      lambda a, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295) % 6)::BIGINT AS h FROM ids),
        turns AS (SELECT conv_id, sha256(length(r) || ':' || r || t)[1:32] AS d, length(t) AS chars,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)[1:32], length(t)) AS n
                  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
        rebuilt AS (SELECT h.conv_id, t.n AS place, d, chars FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.n <= h.h
                    UNION ALL SELECT h.conv_id, h.h + t.n, d, chars FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.n > h.h),
        prefixes AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS prefix, chars FROM rebuilt
                     WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
                     UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
        lengths AS (SELECT conv_id, max(depth) AS whole FROM prefixes GROUP BY conv_id),
        nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256
                  FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, prefix),
        children AS (SELECT prefix[1:32 * (depth - 1)] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        above AS (SELECT n.prefix[1:32 * k] AS prefix, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved
                  FROM nodes n LEFT JOIN children c USING (prefix), LATERAL (SELECT unnest(range(depth + 1)) AS k) GROUP BY 1)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, a.n_leaves, a.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN above a USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:32 * (n.depth - 1)]""",
}
