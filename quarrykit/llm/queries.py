"""Queries of the corpus operators, with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import embedding_dedup, fill_middle, jaccard_join, main_text, mixing, packing, paragraph_dedup, quality, ranked_search, sharding, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), seed=17, temperature=0.5, total=1.0)


OP1_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
sums AS (SELECT sum(n_rows)::DOUBLE AS all_rows, sum(pow(n_rows::DOUBLE, 0.5)::DECIMAL(30,6))::DOUBLE AS all_weight FROM counts),
rates AS (SELECT source, pow(n_rows::DOUBLE, 0.5) / all_weight * all_rows * 1.0 / n_rows AS m FROM counts, sums),
terms(source, m, k, term, upto) AS (
  SELECT source, m, 0::BIGINT, exp(-m), exp(-m) FROM rates
  UNION ALL SELECT source, m, k + 1, term * m / (k + 1), upto + term * m / (k + 1) FROM terms WHERE k < ceil(m + 10 * sqrt(m) + 25)),
cdf AS (SELECT source, list(upto ORDER BY k) AS upto FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(c.upto, lambda x: x <= ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))::BIGINT AS copies
  FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, copies, copy,
  ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM drawn WHERE copies > 0)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), width=5, threshold=0.8)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP6_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base),
windows AS (SELECT doc_id, i, w[i:i + 7] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM parts WHERE len(w) >= 8)),
spots AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, sum(n)::BIGINT AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM spots) GROUP BY doc_id),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(l) AS n_lines, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS.split())))}))) AS stops,
  len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS sames,
  len(list_filter(l, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) AS bullets,
  len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS ellipses
  FROM parts LEFT JOIN covered USING (doc_id)),
ratios AS (SELECT *, greatest(n_words, 1)::DOUBLE AS nw, greatest(n_lines, 1)::DOUBLE AS nl,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
judged AS (SELECT *, concat_ws(',',
  CASE WHEN word_chars / nw < 2 OR word_chars / nw > 14 THEN 'mean_word_length' END,
  CASE WHEN n_symbols / nw > 0.15 THEN 'symbol_ratio' END,
  CASE WHEN bangs / nw > 0.5 THEN 'exclamation_ratio' END,
  CASE WHEN capitals / greatest(word_chars, 1)::DOUBLE > 0.5 THEN 'capital_ratio' END,
  CASE WHEN stops / nw < 0.04 THEN 'stop_word_ratio' END,
  CASE WHEN sames / nw > 0.3 THEN 'same_word_ratio' END,
  CASE WHEN n_dup_lines / nl > 0.5 THEN 'dup_line_ratio' END,
  CASE WHEN bullets / nl > 0.9 THEN 'bullet_line_ratio' END,
  CASE WHEN ellipses / nl > 0.5 THEN 'ellipsis_line_ratio' END) AS failed_rules FROM ratios)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""


def op7_embedding_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")


def op9_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), F.coalesce(fold != 1, F.lit(False)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", "n_words", "n_paragraphs", "kept_doc_ids")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf, n, 25 + (75 * n * docs) // total AS m, docs FROM terms JOIN sizes USING (doc_id), corpus GROUP BY doc_id, term, n, docs, total),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held GROUP BY term, docs),
wanted AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN held USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def op12_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract_main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"), percent=50, spm_percent=80, seed=42)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
ranks AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM drawn),
cut AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM ranks),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN regexp_extract(output, '(?s)^<P>(.*)<S>', 1) || regexp_extract(output, '(?s)<M>(.*)$', 1) || regexp_extract(output, '(?s)<S>(.*)<M>', 1)
    ELSE regexp_extract(output, '(?s)<P>(.*)<M>', 1) || regexp_extract(output, '(?s)<M>(.*)$', 1) || regexp_extract(output, '(?s)^<S>(.*)<P>', 1) END) AS restored_sha256 FROM made
"""


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_exact_complement_packing, op3_suffix_dedup, op4_byte_shards, op5_ngram_jaccard_join, op6_quality_rules, op7_embedding_multi_index,
    op8_warc_normaliser, op9_toxicity_trees, op10_paragraph_dedup, op11_ranked_search, op12_text_density, op13_fill_in_middle,
)}
ORACLE_SQL = {"op1_source_mix": OP1_SQL, "op6_quality_rules": OP6_SQL, "op11_ranked_search": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
