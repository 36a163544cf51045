"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import capture_index, chunk_table, content_sort, edit_embedding, licence_rules, line_crf, orc_tokens, parity_join, phrase_graph, sanitise, slack_packing, spelling_variants, toxic_grammar
from .common import documents, new_path, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprints(documents(spark, sf_dir))


@query
def op2_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack_documents(documents(spark, sf_dir), bpe())


@query
def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir), keep="max")


ORACLE["op3_content_sort"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


@query
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op5_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op6_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.scan(documents(spark, sf_dir))


@query
def op7_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(documents(spark, sf_dir))


@query
def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.personal_data(documents(spark, sf_dir))


@query
def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    orc_tokens.write_ids(documents(spark, sf_dir), path, bpe())
    return orc_tokens.digests(orc_tokens.read_ids(spark, path))


@query
def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


ORACLE["op11_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir))


@query
def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(documents(spark, sf_dir))


ORACLE["op13_phrase_graph"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING size = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
inside AS (
  SELECT DISTINCT lang, a, unnest(list_transform(range(1, len(w) - part + 2), lambda i: array_to_string(w[i:i + part - 1], ' '))) AS phrase
  FROM (SELECT lang, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 2), (SELECT unnest(range(2, 5)) AS part) WHERE part < size),
cand AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.phrase = f.phrase AND i.a >= f.a)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT lang, phrase, a, size, string_split(phrase, ' ') AS w FROM cand), (SELECT unnest(range(1, 5)) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k, ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN n ON n.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000
"""
