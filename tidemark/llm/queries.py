"""Registered queries of the training-data operators: each applies its operator, with production parameters,
to its whole table and derives the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import byte_bpe_round_trip
from tidemark.llm.collocations import phrase_collocations
from tidemark.llm.decontaminate import benchmark_overlap
from tidemark.llm.html_extract import extract_articles
from tidemark.llm.jaccard import ngram_jaccard_classes
from tidemark.llm.pii import personal_digest
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.quality import quality_rules
from tidemark.llm.secrets import ledger_path, secret_digest
from tidemark.llm.source_mix import mix_shares
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.url_filters import judge_urls

#: (host, path, action)
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The id that ends a document in the token files, and the size of their vocabulary.
END_ID, VOCABULARY = 2, 49_408


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"), ledger_path(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID, VOCABULARY)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scans": op4_secret_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_token_output": op10_token_output,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_source_mixing": op12_source_mixing,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {}

SQL["op1_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(r_host, r_path, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT page_id, host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(action, length(r_host || r_path)) AS verdict
  FROM hosts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

SQL["op5_benchmark_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, i, n FROM doc_window JOIN item_window USING (n, g)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op9_ngram_jaccard"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM doc WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM shingle x JOIN shingle y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 85 * (p.n + q.n - same)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM doc LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

#: CRC-32 of the digits of s.
_CRC = """xor(list_reduce(list_transform(range(length(s)), lambda i: ascii(s[i + 1])::BIGINT), lambda a, b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295)"""

SQL["op13_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list({{'s': s, 'w': w}} ORDER BY turn NULLS FIRST, s) AS seq FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT conv_id, conv_id::VARCHAR AS s FROM whole)
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1 : h], c.seq[h + 1 :]) AS seq FROM whole c JOIN crc USING (conv_id) LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefix AS (
  SELECT conv_id, d, seq[1 : d] AS p, len(seq) = d AS ended FROM built, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)
), node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM prefix GROUP BY p, d
), kids AS (
  SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), own AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * node.p[node.d].w END AS saved FROM node LEFT JOIN kids ON kids.p = node.p AND kids.d = node.d
), below AS (
  SELECT p[1 : a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM own, LATERAL (SELECT unnest(range(d + 1)) AS a) GROUP BY ALL
)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN below ON below.p = own.p AND below.d = own.d LEFT JOIN node up ON up.p = own.p[1 : own.d - 1] AND up.d = own.d - 1
"""

SQL["op12_source_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS place FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), numbered AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM sums
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][number % 3 + 1]::DOUBLE AS weight, 3 * source_size AS most FROM numbered
), stops AS (
  SELECT *, sum(source_size) OVER () AS total, sum(most) OVER w AS spent, sum(weight) OVER w AS before, sum(weight) OVER () AS whole FROM weighted
  WINDOW w AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, (most / weight, number)) FILTER (weight * level < most) AS level FROM (SELECT *, (total - coalesce(spent, 0))::DOUBLE / (whole - coalesce(before, 0)) AS level FROM stops)
), targets AS (
  SELECT source, number, source_size, least(coalesce(weight * level, most), most)::DOUBLE AS target FROM weighted, level
), queue AS (
  SELECT doc_id, s.source, number, size, source_size, target, place, sum(size) OVER (PARTITION BY number ORDER BY place, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), sendings AS (
  SELECT *, (turn * source_size + sent)::DOUBLE / target AS finish FROM queue, range(3) r(turn) WHERE size > 0
), spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, number ROWS UNBOUNDED PRECEDING) AS spent, (SELECT sum(size) FROM sizes) AS budget FROM sendings
), taken AS (
  SELECT number, place, size, sum(size)::BIGINT AS taken FROM spent WHERE spent <= budget GROUP BY ALL
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queue LEFT JOIN taken USING (number, place, size)
"""

SQL["op11_phrase_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), counts AS (
  SELECT lang, k, p, count(*) AS a FROM (SELECT lang, k, w[i : i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) r(k))) GROUP BY ALL
), frequent AS (
  SELECT * FROM counts WHERE a >= 30
), cuts AS (
  SELECT f.lang, f.k, f.p, f.a, c AS cut, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM frequent WHERE k > 1) f JOIN frequent x ON x.lang = f.lang AND x.p = f.p[1 : c] JOIN frequent y ON y.lang = f.lang AND y.p = f.p[c + 1 :]
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, p, max(a) AS most FROM (SELECT lang, p[i : i + n - 1] AS p, a FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM frequent WHERE k > 2))) GROUP BY ALL
), kept AS (
  SELECT least.* FROM least LEFT JOIN inside USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
