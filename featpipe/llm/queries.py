"""The dealt operators' queries: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from featpipe.llm import (chains, chat, decontaminate, hard_negatives, jaccard, pieces, pitman_yor, quality, sharding, simhash, surrogates,
                          tokencount, vector_codes)
from featpipe.llm.common import read

# SQL text of the folding of A-Z and of the white space set
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op7_benchmark_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_windows(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


_OP7_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP7_WORDS} AS w FROM benchmark),
lens AS (SELECT DISTINCT least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.i, bw.item FROM dw JOIN bw USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op5_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))



def op1_pitman_yor(spark, sf_dir):
    return pitman_yor.score_texts(read(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    plan = sharding.assign_shards(read(spark, sf_dir, "documents"), shards=40)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op4_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = chat.format_conversations(turns)
    lost = chat.masked(chat.expand_targets(formatted), formatted).withColumnRenamed("conv_id", "c")
    text = formatted.select("conv_id", F.array_join("segments", "").alias("formatted"))
    back = text.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                       chat.read_turns(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.coalesce("loss_text", F.lit(""))
    return back.join(lost, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce("context_chars", F.lit(0)).cast("long").alias("context_chars"))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, 18 + length(regexp_replace(role || text, '([\[<\\])', '\1\1', 'g')) AS n FROM c),
f AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - n AS ahead FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(coalesce(sum(ahead) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM f GROUP BY conv_id
"""


def op6_substring_dedup(spark, sf_dir):
    return chains.repeated_passages(read(spark, sf_dir, "documents"))


PII_KEY = "surrogate-key-1"  # in production a secret of the pipeline's owner


def op8_pii_surrogates(spark, sf_dir):
    return surrogates.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")



def op10_jaccard_join(spark, sf_dir):
    return jaccard.similar_groups(read(spark, sf_dir, "documents"), n=3, percent=90)


_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+')"

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q USING (doc_id)
"""


def op11_vector_codes(spark, sf_dir):
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(codes).select(
        F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


# rows taking part, as integers (64-bit; all products and sums below fit)
_VECTORS = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _op11_sql() -> str:
    steps = [f"""WITH r AS ({_VECTORS}),
p AS (SELECT vec_id, label, k, list_slice(v, k * (len(v) // 16) + 1, (k + 1) * (len(v) // 16)) AS x
      FROM (SELECT *, unnest(range(16)) AS k FROM r)),
b0 AS (SELECT k, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM r ORDER BY vec_id LIMIT 64) USING (vec_id))"""]
    for i in range(3):
        steps.append(f"""a{i} AS (SELECT vec_id, label, k, x, min(struct_pack(d := d, e := e)) AS m
      FROM (SELECT p.vec_id, p.label, p.k, p.x, e, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS d
            FROM p JOIN b{i} b USING (k)) GROUP BY ALL)""")
        if i < 2:
            steps.append(f"""s{i} AS (SELECT k, e, list(s ORDER BY i) AS y FROM
      (SELECT k, m.e AS e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS s
       FROM (SELECT k, m, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{i}) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS (SELECT k, e, coalesce(y, x) AS x FROM b{i} LEFT JOIN s{i} USING (k, e))""")
    steps.append("""h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS h FROM b2),
t AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM t, h""")
    return ",\n".join(steps)


def op12_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")))


OP12_SQL = f"""
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_VECTORS}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
             CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
      FROM k a JOIN k r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("print")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_sharding": op2_sharding,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash": op13_simhash,
}
ORACLES = {"op4_chat_formatting": OP4_SQL, "op7_benchmark_decontamination": OP7_SQL, "op10_jaccard_join": OP10_SQL,
           "op11_vector_codes": _op11_sql(), "op12_hard_negatives": OP12_SQL}
