"""The registered queries of the training-data operators: each reads its whole table and returns digests of the operator's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, flac, hard_negatives, line_dedup, lm_score, near_dedup, packing, quality, secrets, source_audit, token_count, url_trust
from .common import documents

#: The tokenizer file of the registered queries.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=3, similarity=0.85)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir, "doc_id", "text", "source"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), TOKENIZER, length=1024, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(turns.unionByName(added))
    back = chat.read_back(chats.select("conv_id", "formatted", "pieces", F.length("formatted").cast("long").alias("formatted_chars")), "conv_id", "formatted_chars")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir, "doc_id", "text", "lang"), profile_col="lang")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), flac.stored(F.col("text")).alias("media"))
    read = docs.withColumn("d", flac.decoded(F.col("media"))).select("*", flac.joined(F.col("d.blocks")).alias("payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "d.feature",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_trust.judged(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audited(documents(spark, sf_dir, "lang", "source", "text"), min_docs=10, top_terms=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.expr("if(id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mined(vectors, anchor=F.expr("id % 100 = 0"), relabel=moved, positives=5, negatives=10, low=30, high=90)


def op13_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), TOKENIZER, limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def columns_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op7: all but the model's own scores."""
    return op7_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def columns_of_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8: the payload read back."""
    return op8_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def columns_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9: the base, and that what fails it isn't kept."""
    return op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("base_failed") & F.col("kept")).alias("kept_in_spite"))


def columns_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10: hosts, paths, and the verdicts that rules give."""
    return op10_url_trust(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


#: Queries over the columns that SQL can check of operators that it can't express whole.
PARTS = (columns_of_op7, columns_of_op8, columns_of_op9, columns_of_op10)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_line_dedup, op2_near_dedup, op3_secrets, op4_bpe, op5_packing, op6_chat, op7_lm_score, op8_flac, op9_quality, op10_url_trust, op11_source_audit, op12_hard_negatives, op13_token_count, *PARTS)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_near_dedup": OP2_SQL, "op6_chat": OP6_SQL, "op11_source_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL, "columns_of_op7": OP7_BASE_SQL, "columns_of_op8": OP8_PAYLOAD_SQL, "columns_of_op9": OP9_BASE_SQL, "columns_of_op10": OP10_RULE_SQL}


def _crc32_sql(digits: str) -> str:
    """CRC-32 of bytes in hexadecimal, bit by bit."""
    value = lambda at: f"(instr('0123456789ABCDEF', substr({digits}, CAST({at} AS BIGINT), 1)) - 1)"
    byte = f"({value('2 * i + 1')} * 16 + {value('2 * i + 2')})"
    bits = f"flatten(list_transform(range(length({digits}) // 2), lambda i: list_transform(range(8), lambda k: CAST(({byte} >> k) & 1 AS BIGINT))))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), CAST(4294967295 AS BIGINT))"


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_az AS key
  FROM (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (
      SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))))
, shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
, marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents)
, shingles AS (
  SELECT DISTINCT doc_id,
         unnest(CASE WHEN len(words) >= 3
                     THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle
  FROM worded)
, sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
, common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id)
, links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * common.n >= 85 * (a.n + b.n - common.n))
, edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links)
, reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, edges.y FROM reached JOIN edges ON edges.x = reached.other)
, lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: The lengths of the template's control strings (chat.py) stand as numbers in the sum of formatted_chars.
OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
, placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) AS escaped,
         length(role) + length(regexp_replace(role, '[^\\\[<]', '', 'g')) AS escaped_role
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(escaped
         + CASE WHEN before = role THEN 6 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 8 ELSE 15 + escaped_role END
         + CASE WHEN after = role THEN 0 WHEN role = 'user' THEN 8 ELSE 4 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents)
, words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
, terms AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10)
, sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY lang)
, sources AS (SELECT DISTINCT lang, source FROM docs)
, found AS (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN terms USING (lang, term) GROUP BY lang, source, term)
, grid AS (
  SELECT s.lang, s.source, t.term, coalesce(f.c, 0) AS c, t.total
  FROM sources s JOIN terms t ON t.lang = s.lang
  LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = t.term)
, shares AS (
  SELECT g.lang, g.source, g.term, g.c,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (g.c + 2) // (sum(g.c) OVER (PARTITION BY g.lang, g.source) + 2 * z.v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (g.total + 2) // (z.n + 2 * z.v) AS BIGINT) AS q
  FROM grid g JOIN sizes z ON z.lang = g.lang)
, pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source)
, rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = r"""
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 100 = 0)
, positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_BASE_SQL = rf"""
WITH tokens AS (
  SELECT doc_id, {_crc32_sql("hex(encode(CAST(doc_id AS VARCHAR)))")} % 5 = 1 AS held_out,
         list_append(regexp_extract_all({LOWER_AZ}, '[^\x20\x09-\x0D]+'), chr(10)) AS words
  FROM documents)
, each AS (SELECT doc_id, held_out, unnest(words) AS word FROM tokens)
, seen AS (SELECT word, count(*) AS c FROM each WHERE NOT held_out GROUP BY word)
, total AS (SELECT sum(c) AS n, count(*) AS v FROM seen)
SELECT e.doc_id, e.held_out, count(*) AS n_tokens, count(s.c) AS n_known, CAST(t.n AS BIGINT) AS train_tokens,
       round(sum(log10(coalesce(s.c, 0) + 0.5)) - count(*) * log10(t.n + 0.5 * (t.v + 1)), 3) AS base_score
FROM each e LEFT JOIN seen s ON s.word = e.word CROSS JOIN total t
GROUP BY e.doc_id, e.held_out, t.n, t.v
"""

OP8_PAYLOAD_SQL = rf"""
SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(text || repeat(' ', pad)) AS payload_sha256,
       {_crc32_sql("tail")} AS tail_crc32
FROM (SELECT *, right(hex(encode(right(text, 16) || repeat(' ', pad))), 32) AS tail FROM (SELECT doc_id, text, n_bytes, CAST(greatest(1, (n_bytes + 191) // 192) * 192 - n_bytes AS BIGINT) AS pad
      FROM (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents)))
"""

OP9_BASE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
, windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3))
, twice AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM windows SEMI JOIN (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1) d USING (doc_id, w))
, repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id)
, lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(words) AS base_failed, FALSE AS kept_in_spite
FROM docs d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id
"""

OP10_RULE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
, places AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
, rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                        ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, domain, begins))
SELECT p.page_id, p.host, p.path, r.domain || r.begins AS rule, r.verdict AS ruled
FROM places p LEFT JOIN rules r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.begins)
QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.domain || r.begins) DESC NULLS LAST) = 1
"""
