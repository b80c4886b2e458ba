"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import align, decontaminate, fim, fingerprint, jaccard, langid, mixing, packing, pii, secrets, token_count, toxicity, warc
from veilframe.llm.common import fresh_path, held_out, table

#: Target weights of the mix; other sources weigh 1 each.
MIX_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "src4": 0.5}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary; operators that use one take its path as a parameter."""
    return public_tokenizers.path(name)


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out(docs["doc_id"])))
    return langid.identify(docs, model)


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_heap_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_join(table(spark, sf_dir, "documents"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.learn(docs))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    return warc.page_records(warc.read_archive(spark, archive, payloads=False))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_lstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


QUERIES = {
    f.__name__: f
    for f in (op1_poisson_mix, op2_prefix_fingerprint, op3_ppm_language, op4_pu_toxicity, op5_pigeonhole_leaks, op6_heap_token_count, op7_best_fit_packing, op8_ngram_jaccard, op9_markov_secrets, op10_warc_salvage, op11_fill_in_middle, op12_token_alignment, op13_lstm_pii)
}

_WEIGHT = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items()) + " ELSE 1.0 END"

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL = {
    "op1_poisson_mix": f"""
WITH sizes AS (SELECT source, count(*) AS n, {_WEIGHT} AS w FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * (w / (SELECT sum(w) FROM sizes)) / n AS rate FROM sizes),
parts AS (SELECT source, i AS part, rate / greatest(ceil(rate / 32.0), 1) AS r
          FROM rates, LATERAL (SELECT unnest(generate_series(1, greatest(ceil(rate / 32.0), 1)::BIGINT)) AS i)),
terms AS (SELECT source, part, j, exp(-r + j * ln(r) - lgamma(j + 1)) AS p
          FROM parts, LATERAL (SELECT unnest(generate_series(0, ceil(r + 12 * sqrt(r) + 30)::BIGINT)) AS j) WHERE r > 0),
tables AS (SELECT source, part, sum(p) OVER (PARTITION BY source, part ORDER BY j) AS c FROM terms),
draws AS (SELECT d.*, part, ('0x' || substr(md5('mix|count|' || coalesce(doc_id::VARCHAR, '') || '|' || part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
          FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(t.c) AS k
           FROM draws d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source AND d.part = t.part AND t.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('mix|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key
FROM counts, LATERAL (SELECT unnest(generate_series(1, k)) AS copy)
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM grams GROUP BY doc_id),
kinds AS (SELECT k, any_value(n) AS n, min(doc_id) AS first_id, count(*) AS copies FROM sets GROUP BY k),
members AS (SELECT kinds.k, kinds.n, grams.g FROM kinds JOIN grams ON grams.doc_id = kinds.first_id),
near AS (SELECT a.k AS a, b.k AS b FROM members a JOIN members b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
         GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT k, k AS m FROM kinds UNION SELECT r.k, l.b FROM reach r JOIN links l ON r.m = l.a),
least_id AS (SELECT r.k, min(kinds.first_id) AS component_id FROM reach r JOIN kinds ON kinds.k = r.m GROUP BY r.k),
weight AS (SELECT l.a AS k, sum(kinds.copies) AS linked FROM links l JOIN kinds ON kinds.k = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(i.component_id, d.doc_id)::BIGINT AS component_id,
       (coalesce(kinds.copies - 1, 0) + coalesce(w.linked, 0))::BIGINT AS n_links
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN kinds ON kinds.k = s.k LEFT JOIN least_id i ON i.k = s.k LEFT JOIN weight w ON w.k = s.k
""",
    "op10_warc_salvage": """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, n, array_to_string(list_transform(range(1, 41), lambda i:
  ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS b FROM hashed),
coded AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
  + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS digest FROM bits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM coded)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM firsts
""",
    "op11_fill_in_middle": """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
                 ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS c4 FROM hashed),
cuts AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
""",
}
