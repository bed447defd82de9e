"""The operators' queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.llm.ball_tree import top_products
from trialscope.llm.chat_format import conversation_events, format_chat, read_back
from trialscope.llm.common import kept_table, new_path, table, tokenizer_file
from trialscope.llm.exact_dedup import exact_dedup
from trialscope.llm.hard_negatives import hard_negatives
from trialscope.llm.jaccard_join import jaccard_components
from trialscope.llm.licences import scan_licences
from trialscope.llm.merkle import edit_likeness
from trialscope.llm.packing import pack, tokenised_pieces
from trialscope.llm.piece_bpe import piece_digests
from trialscope.llm.quality_gam import score_quality
from trialscope.llm.spelling import spelling_variants
from trialscope.llm.toxicity_lm import score_toxicity
from trialscope.llm.warc import read_digests, write_archives


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces, _ = kept_table(tokenised_pieces(docs, tokenizer_path or tokenizer_file("byte_bpe_50k.json")), "pieces")
    return pack(pieces, pieces.count())


def op5_piece_bpe(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model_path or tokenizer_file("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    return read_digests(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM g
"""


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licences"), F.array_join("found.licence", ",").alias("licences"))


OP7_SQL = r"""
WITH s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+([ \t\r\n\f\v]+|$)|\n+') AS parts FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: CASE trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))
    WHEN 'licensed under the apache license version 2 0' THEN 'Apache-2.0'
    WHEN 'this work is licensed under the gnu general public license version 3' THEN 'GPL-3.0'
    WHEN 'released under the mit license' THEN 'MIT'
    WHEN 'licensed under cc by nc 4 0' THEN 'CC-BY-NC-4.0' END), lambda x: x IS NOT NULL) AS found FROM s)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_licences, array_to_string(found, ',') AS licences FROM k
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted, _ = kept_table(format_chat(conversation_events(rows)), "chat")
    return read_back(formatted)


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op11_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


#: Vectors as whole numbers; those that take no part are left out.
_WHOLE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""
OP11_SQL = f"""
WITH {_WHOLE},
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label)


OP12_SQL = f"""
WITH {_WHOLE},
w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM w a JOIN w b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The crc32 by its table; near words by the texts that are left when a letter is taken out.
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
b AS (SELECT id, run, list_transform(range(1, 2 * octet_length(encode(concat(id, ':', run))), 2), lambda i: CAST(concat('0x', hex(encode(concat(id, ':', run)))[i:i + 1]) AS BIGINT)) AS bytes FROM r WHERE length(run) >= 7),
h AS (SELECT run, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(run[1:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word FROM h) x WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, i, concat(word[1:i], word[i + 2:]) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w) x),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
q AS (SELECT p.a AS word, p.b AS near, w.n AS near_n, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS k, count(*) OVER (PARTITION BY p.a) AS n_near FROM p JOIN w ON w.word = p.b),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN q ON q.word = w.word AND k = 1),
c AS (SELECT word, word AS at, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.at AND f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(c.at, depth) FROM c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality_gam": op2_quality_gam,
        "op4_toxicity_lm": op4_toxicity_lm,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op5_piece_bpe": op5_piece_bpe,
        "op6_warc": op6_warc,
        "op7_licence_scan": op7_licence_scan,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_document_fingerprints": op10_document_fingerprints,
        "op11_ball_tree_top_k": op11_ball_tree_top_k,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op7_licence_scan": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_ball_tree_top_k": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
