"""The opN_ queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import ann, bpe, chat, divergence, langid, linededup, mixing, pii, quality, secretscan, sharding, simhash, trie
from lexweave.session import table
from lexweave.staging import stage


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_digest(secretscan.find_secrets(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.quality_features(table(spark, sf_dir, "documents")).select("doc_id", "source", *quality.FEATURES, "base_failed")
    features = stage(features, "quality-features")
    judged = quality.apply_verdicts(features, quality.host_verdicts(features))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed_lines", "text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), speaker.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    conversations = table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)
    return chat.digests(stage(chat.format_chats(conversations), "formatted"))


def queries() -> dict:
    found = (op1_learned_partitions, op2_mixing, op3_secrets, op4_byte_bpe, op5_language_id, op6_host_quality, op7_simhash, op8_sharding, op9_line_dedup, op10_pii, op11_source_divergence, op12_prefix_trie, op13_chat_format)
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w
), win AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v || ' ' || lead(word, 4) OVER v AS g
  FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM win WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT coalesce(avg(bad / n), 0) AS m, coalesce(var_samp(bad / n), 0) AS v FROM h
), p AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 100.0 END AS k FROM m
), verdict AS (
  SELECT source, (bad + m * k) / (n + k) > 0.5 AS host_bad FROM h, p
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_bad, false) AS kept
FROM b LEFT JOIN verdict ON verdict.source = b.source
"""

OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 5 AS counts FROM l
), spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM k WHERE counts GROUP BY line HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT k.*, spread.line IS NOT NULL AND k.counts AND (k.doc_id, k.pos) <> spread.first AS gone
  FROM k LEFT JOIN spread ON spread.line = k.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed_lines,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL FROM documents WHERE text IS NULL
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT lang, source, doc, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = o.lang AND c.source = o.source), 0)::HUGEINT AS size,
         (SELECT count(*) FROM kept WHERE kept.lang = o.lang)::HUGEINT AS v, coalesce((SELECT sum(n) FROM kept WHERE kept.lang = o.lang), 0)::HUGEINT AS lang_size
  FROM (SELECT DISTINCT lang, source FROM d) AS o
), r AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.size + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 5)) // (g.lang_size + 5 * g.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), gap AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM r AS a JOIN r AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gap.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM r WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


OP12_SQL = r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 5 AS base, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))).xor(4294967295)) % 9 AS h, n
  FROM (SELECT c, count(*) AS n FROM o GROUP BY c)
), plan AS (
  SELECT a.c, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM ids AS a LEFT JOIN ids AS b ON b.c = a.base
), turns AS (
  SELECT plan.c, o.i AS d, role, text FROM plan JOIN o ON o.c = plan.base AND o.i <= plan.h
  UNION ALL SELECT plan.c, o.i - plan.h + plan.taken, role, text FROM plan JOIN o ON o.c = plan.c AND o.i > plan.h
), p AS (
  SELECT c, d, octet_length(encode(text)) AS bytes, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d) OVER w) AS k FROM turns WINDOW w AS (PARTITION BY c ORDER BY d)
  UNION ALL SELECT c, 0, 0, '' FROM plan
), ends AS (
  SELECT c, max(d) AS d FROM p GROUP BY c
), node AS (
  SELECT d, k, min(p.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM p GROUP BY d, k
), fin AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS l FROM p JOIN ends USING (c, d) GROUP BY d, k
), up AS (
  SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM p AS a JOIN p AS b ON a.c = b.c AND b.d >= a.d
), kid AS (
  SELECT d, k, count(*) AS n FROM up WHERE bd = d + 1 GROUP BY d, k
), below AS (
  SELECT up.d, up.k, count(*) FILTER (kid.n IS NULL) AS n_leaves, sum(node.saved)::BIGINT AS saved
  FROM up JOIN node ON node.d = up.bd AND node.k = up.bk LEFT JOIN kid ON kid.d = up.bd AND kid.k = up.bk GROUP BY up.d, up.k
), parent AS (
  SELECT up.bd AS d, up.bk AS k, node.conv_id FROM up JOIN node ON node.d = up.d AND node.k = up.k WHERE up.bd = up.d + 1
)
SELECT node.conv_id, node.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kid.n, 0) AS n_children,
       below.n_leaves, below.saved AS saved_tokens, sha256(coalesce(fin.l, '')) AS ends_sha256
FROM node JOIN below USING (d, k) LEFT JOIN kid USING (d, k) LEFT JOIN fin USING (d, k) LEFT JOIN parent USING (d, k)
"""

OP13_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opened
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|ANS\]|TURN\]|BODY\])', '\1\\\2\3', 'g'))
         + CASE WHEN NOT opened THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9
           ELSE 19 + length(regexp_replace(role, '([\[<])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|ANS\]|TURN\]|BODY\])', '\1\\\2\3', 'g')) END AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """Only these are expressible in SQL; the others are tested against brute force."""
    return {"op6_host_quality": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_chat_format": OP13_SQL}
