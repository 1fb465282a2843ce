"""The queries that apply the corpus operators to the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hnsw, host_rules, language_id, lm_score, mixing, partenum, token_counts, token_store, toxicity, vector_codes, whitening
from .common import table

MIX = mixing.MixConfig(domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang_weights={"en": 1, "de": 2, "fr": 2, "es": 3})


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_score.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, learned)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    return toxicity.classify(docs, chain)


def op8_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat_format.format_chats(turns.unionByName(added))
    back = made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
laid AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE role_chars + 23 END)::BIGINT AS formatted_chars
FROM laid GROUP BY conv_id"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)"""


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN covered ON covered.r = d.r),
said AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words] AS fails FROM m),
rules AS (SELECT source, k, count(*) AS n, sum(fails[k]::BIGINT) AS f FROM said, (SELECT unnest(range(1, 6)) AS k) WHERE source IS NOT NULL GROUP BY source, k),
prior AS (
  SELECT k, p, (1 - c) / c AS strength FROM (
    SELECT k, p, least(0.999, greatest(1e-4, CASE WHEN room > 0 THEN (between_ - p * (1 - p) * (h - 1)) / room ELSE 1e-4 END)) AS c FROM (
      SELECT k, p, h, sum_ratio - p * all_f AS between_, p * (1 - p) * (total - squares / total - (h - 1)) AS room FROM (
        SELECT k, count(*) AS h, sum(n)::DOUBLE AS total, sum(f)::DOUBLE AS all_f, sum(f)::DOUBLE / sum(n)::DOUBLE AS p, sum(n::DOUBLE * n) AS squares, sum(f::DOUBLE * f / n) AS sum_ratio FROM rules GROUP BY k)))),
failing AS (
  SELECT DISTINCT source FROM (SELECT source, n, strength, (f + p * strength) / (n + strength) AS rate FROM rules JOIN prior USING (k))
  WHERE rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND source NOT IN (SELECT source FROM failing) IS NOT FALSE AS kept FROM said"""


def vector_codes_sql(scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The codes and codebooks of operator 12 by full search, a pair of tables for each round."""
    assigned = """a{r} AS (
  SELECT id, p, e, err, q FROM (
    SELECT v.id, v.p, b.e, v.q, list_sum(list_transform(range(1, len(v.q) + 1), lambda i: (v.q[i] - b.c[i]) * (v.q[i] - b.c[i])))::BIGINT AS err,
      row_number() OVER (PARTITION BY v.id, v.p ORDER BY list_sum(list_transform(range(1, len(v.q) + 1), lambda i: (v.q[i] - b.c[i]) * (v.q[i] - b.c[i]))), b.e) AS place
    FROM v JOIN b{r} b ON v.p = b.p) WHERE place = 1)"""
    moved = """b{s} AS (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(q[i]) / count(*))::BIGINT AS m FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(q)) + 1 FROM v))) AS i) GROUP BY p, e, i)
    GROUP BY p, e) n USING (p, e))"""
    steps = []
    for r in range(rounds):
        steps += [assigned.format(r=r), moved.format(r=r, s=r + 1)]
    steps.append(assigned.format(r=rounds))
    return f"""
WITH x AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS id, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))),
v AS (SELECT id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS q FROM x, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, id - 1 AS e, q AS c FROM v WHERE id <= {entries}),
{", ".join(steps)},
done AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM a{rounds} GROUP BY id),
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM done JOIN x USING (id), told"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_lm_score, op4_token_counts, op5_language_id, op6_token_store, op7_toxicity, op8_embedding_near, op9_ngram_jaccard, op10_chat_format, op11_whiten_embeddings, op12_vector_codes, op13_host_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.mix_sql(MIX), "op2_decontaminate": OP2_SQL, "op10_chat_format": OP10_SQL, "op12_vector_codes": vector_codes_sql(), "op13_host_rules": OP13_SQL}
