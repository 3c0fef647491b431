"""The operators' queries over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffusio.llm import alignment, chat, decontaminate, exactdup, langid, manifest, neardup, packing, quality, secrets, toxicity, urls
from diffusio.session import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


#: A dated list for the pages' domains. Fixed values of the query.
LIST = """(VALUES
  ('spam-farm.example.org', 'block', DATE '2024-01-01'),
  ('tionsh.example.net', 'block', DATE '2024-02-01'),
  ('tionsh.example.net', 'remove', DATE '2024-06-15'),
  ('tionsh.example.net/en', 'allow', DATE '2024-03-10'),
  ('tionsh.example.net/fr', 'block', DATE '2024-07-01'),
  ('tionble.example.com', 'block', DATE '2024-04-01'),
  ('blog.tionble.example.com', 'allow', DATE '2024-05-20'),
  ('m.tiontion.example.com', 'block', DATE '2024-01-20'),
  ('m.tiontion.example.com', 'allow', DATE '2024-08-08'),
  ('ththth.example.org', 'block', DATE '2023-11-05'),
  ('ththth.example.org', 'remove', DATE '2024-09-09'),
  ('blog.ththth.example.org/de', 'allow', DATE '2024-02-29'),
  ('thther.example.org', 'block', DATE '2024-10-01'),
  ('example.com/en', 'block', DATE '2024-01-01'),
  ('ththon.example.com', 'allow', DATE '2024-01-01'),
  ('ththan.example.net', 'block', DATE '2024-03-03'),
  ('ththan.example.net', 'remove', DATE '2024-03-04')
) AS t(key, action, effective)"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the dated list; the tables have no fetch date, so it is spread over 2024 by page_id."""
    entries = spark.sql(f"SELECT * FROM {LIST}")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(366))).cast("int"))
    return urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at")), entries)


_URL = urls.URL.replace("'", "''")
OP2_SQL = f"""
WITH list AS (SELECT key, effective AS since, action, lead(effective) OVER (PARTITION BY key ORDER BY effective) AS until FROM {LIST}),
valid AS (SELECT * FROM list WHERE action <> 'remove'),
rows AS (SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_at,
  nullif(regexp_replace(regexp_extract(lower(url), '{_URL}', 1), '\\.$', ''), '') AS host, regexp_extract(lower(url), '{_URL}', 2) AS segment FROM pages),
keyed AS (SELECT page_id, host, fetched_at, v.key, v.action FROM rows LEFT JOIN valid v
  ON (host = v.key OR (ends_with(host, '.' || v.key) AND contains(v.key, '.')) OR (segment <> '' AND host || '/' || segment = v.key)) AND fetched_at >= v.since AND (v.until IS NULL OR fetched_at < v.until)),
ranked AS (SELECT *, count(key) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC NULLS LAST, key DESC) AS r FROM keyed)
SELECT page_id, host, fetched_at, n AS n_active, key AS matched_key, action, coalesce(action <> 'block', true) AS kept FROM ranked WHERE r = 1
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the queries: that of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest_contamination(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))


def op6_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as matrices of 2048 ids, written and read back, by checksums and listings."""
    place = f"{shared_folder(spark)}/matrices-{uuid.uuid4().hex}"
    packing.write_matrices(packing.pack_matrices(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0), place)
    return packing.digest_matrices(packing.read_matrices(spark, place))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in all documents."""
    return secrets.digest_secrets(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from rows whose crc32(doc_id) mod 3 isn't 1; all predicted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(_crc() % 3 != 1))
    return langid.identify(docs, model, "doc_id", F.coalesce(_crc() % 3 == 1, F.lit(False)).alias("held_out"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from labels of rows whose crc32(doc_id) mod 4 isn't 2; all scored."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(_crc() % 4 != 2))
    scored = toxicity.score(docs, model)
    predicted = (F.col("toxicity") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", F.coalesce(_crc() % 4 == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies in all documents."""
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, a fifth of them tampered with."""
    return manifest.digest_proofs(manifest.prove(_table(spark, sf_dir, "documents"), manifest.lowered()))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("n_chars")


OP13_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w
"""

# trees by levels, then for each document the fold of its levels; crc32 of the digits by its table
OP12_SQL = """
WITH RECURSIVE crc_bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS v FROM crc_bits WHERE k = 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS v FROM documents
  UNION ALL SELECT doc_id, s, k + 1, xor(v // 256, (SELECT t.v FROM crc_table t)[CAST(xor(v, ascii(s[k + 1])) % 256 AS INTEGER) + 1]) FROM crc WHERE k < length(s)),
hit AS (SELECT DISTINCT doc_id FROM crc WHERE k = length(s) AND xor(v, 4294967295) % 5 = 0),
fields AS (SELECT d.doc_id, source,
  coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body,
  CASE WHEN h.doc_id IS NULL THEN coalesce(strlen(text) || ':' || text, '-') ELSE coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') END AS seen
  FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id),
leaves AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || seen) AS seen, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM fields),
nodes AS (SELECT source, 0 AS level, pos, n AS size, leaf AS digest FROM leaves
  UNION ALL SELECT source, level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY source, level, pos // 16, size),
tops AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
over AS (SELECT 0 AS level, pos, size, digest FROM tops
  UNION ALL SELECT level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE size > 1 GROUP BY level, pos // 16, size),
runs AS (SELECT source, level, pos // 16 AS run, size, list(digest ORDER BY pos) AS kids FROM nodes WHERE size > 1 GROUP BY source, level, pos // 16, size),
over_runs AS (SELECT level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM over WHERE size > 1 GROUP BY level, pos // 16, size),
fold AS (SELECT doc_id, source, leaf, pos, 0 AS level, seen AS digest, '' AS siblings FROM leaves
  UNION ALL SELECT doc_id, f.source, leaf, f.pos // 16, f.level + 1,
    sha256(array_to_string(kids[: f.pos % 16], '') || digest || array_to_string(kids[f.pos % 16 + 2 :], '')), siblings || array_to_string(kids[: f.pos % 16], '') || array_to_string(kids[f.pos % 16 + 2 :], '')
  FROM fold f JOIN runs r ON f.source IS NOT DISTINCT FROM r.source AND f.level = r.level AND f.pos // 16 = r.run),
low AS (SELECT f.doc_id, f.leaf, f.digest, f.siblings, t.digest AS subroot, t.pos FROM fold f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source JOIN nodes x ON x.source IS NOT DISTINCT FROM f.source AND x.size = 1 AND x.level = f.level),
high AS (SELECT doc_id, leaf, subroot, pos, 0 AS level, digest, siblings FROM low
  UNION ALL SELECT doc_id, leaf, subroot, h.pos // 16, h.level + 1,
    sha256(array_to_string(kids[: h.pos % 16], '') || digest || array_to_string(kids[h.pos % 16 + 2 :], '')), siblings || array_to_string(kids[: h.pos % 16], '') || array_to_string(kids[h.pos % 16 + 2 :], '')
  FROM high h JOIN over_runs r ON h.level = r.level AND h.pos // 16 = r.run)
SELECT doc_id, leaf, subroot, o.digest AS root, sha256(siblings) AS proof_sha256, h.digest AS folded_root, h.digest = o.digest AS verified
FROM high h JOIN over o ON o.size = 1 AND o.level = h.level
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_url_filters,
        op3_ngram_jaccard_join,
        op4_best_fit_packing,
        op5_benchmark_decontamination,
        op6_token_binary_output,
        op7_secret_scans,
        op8_language_id,
        op9_quality_rules,
        op10_toxicity,
        op11_cross_tokenizer_alignment,
        op12_merkle_manifest,
        op13_exact_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_url_filters": OP2_SQL, "op12_merkle_manifest": OP12_SQL, "op13_exact_dedup": OP13_SQL}
