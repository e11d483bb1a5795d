"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import counts, decontam, embeddings, lines, merkle, mixing, ngram_ratio, quality, simhash, tokenfile, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), bits=2, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removals(table(spark, sf_dir, "documents"), min_words=50).select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = tokenfile.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, manifest)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    r = warc.read(spark, path)
    response = F.col("record_type") == "response"
    return r.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, trusted = table(spark, sf_dir, "documents"), ngram_ratio.trusted_of(table(spark, sf_dir, "labels"))
    return ngram_ratio.judge(docs, trusted, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


ORACLE = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM s),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3 AS room, source_size * 3 / ((k - 1) % 3 + 1)::DOUBLE AS fills FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER u, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS level
      FROM w WINDOW u AS (ORDER BY fills, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, round(least(room::DOUBLE, max(CASE WHEN level <= fills THEN level END) OVER () * weight), 6) AS target FROM l),
e AS (SELECT *, round(sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () * 2147483648)::BIGINT AS hi,
        sum(source_size) OVER () AS total FROM t),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo FROM e),
z AS (SELECT least(2147483648, greatest(1048576, CASE WHEN count(*) > 1 THEN (2 ** ceil(log2(count(*))))::BIGINT ELSE 1 END)) AS slots FROM documents),
g AS (SELECT (i * 1327217885) % 2147483648 AS u FROM (SELECT unnest(range(slots)) AS i FROM z)),
n AS (SELECT b.k, count(g.u) AS n_slots FROM b LEFT JOIN g ON g.u >= b.lo AND g.u < b.hi GROUP BY b.k),
y AS (SELECT b.*, least(round(n.n_slots * (b.total / z.slots::DOUBLE))::BIGINT, b.source_size * 3) AS scheduled FROM b JOIN n USING (k), z),
p AS (SELECT *, CASE WHEN abs(scheduled - target) > greatest(1.0, target * 0.001) THEN round(target)::BIGINT ELSE scheduled END AS words_taken FROM y),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.words_taken,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (words_taken // source_size) * size
     + greatest(0, least(start + size, words_taken % source_size) - start) ELSE 0 END)::BIGINT AS taken FROM x""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE ring AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))),
d AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 ELSE false END AS tampered FROM documents, ring),
f AS (SELECT doc_id, lang, tampered, n_chars, list_transform([doc_id::VARCHAR, source, lang], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS a, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS z FROM d),
h AS (SELECT doc_id, lang, sha256(array_to_string(a, '') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || z) AS leaf,
  CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(array_to_string(a, '') || strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR || z) END AS other FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
tree AS (SELECT lang, 0 AS level, i, n, leaf AS digest FROM l UNION ALL
  SELECT lang, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, n, subroot AS digest FROM s UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
w AS (SELECT doc_id, leaf, l.lang, s.subroot, s.g, 0 AS level, i, l.n, coalesce(other, leaf) AS folded, '' AS seen, false AS above FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.subroot, w.g, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN t.digest IS NULL THEN w.folded WHEN w.i % 2 = 0 THEN w.folded || t.digest ELSE t.digest || w.folded END), w.seen || coalesce(t.digest, ''), false
  FROM w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.i = xor(w.i, 1) WHERE w.n > 1),
v AS (SELECT doc_id, leaf, subroot, 0 AS level, g AS i, (SELECT count(*) FROM s) AS n, folded, seen FROM w WHERE n = 1 UNION ALL
  SELECT v.doc_id, v.leaf, v.subroot, v.level + 1, v.i // 2, (v.n + 1) // 2,
    sha256(CASE WHEN t.digest IS NULL THEN v.folded WHEN v.i % 2 = 0 THEN v.folded || t.digest ELSE t.digest || v.folded END), v.seen || coalesce(t.digest, '')
  FROM v LEFT JOIN top t ON t.level = v.level AND t.i = xor(v.i, 1) WHERE v.n > 1)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(seen) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM v, (SELECT digest FROM top WHERE n = 1) r WHERE v.n = 1""",
}
