"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, forest, infill, langid, licenses, pieces, pseudonyms, quality_rules, repeats, simhash, toxicity, variants
from .common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that stand in a 200-byte string found elsewhere too; null texts are empty."""
    return repeats.repeated_bytes(read(spark, sf_dir, "documents")).drop("kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of embeddings at cosine 0.95, and their components; unusable vectors link with nothing."""
    return forest.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows that are not held out; null and empty texts get the score of the class shares."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms, under the session's key; null texts stay null."""
    return pseudonyms.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that stand in a window of 35 words found elsewhere too; null texts have none."""
    return repeats.repeated_words(read(spark, sf_dir, "documents")).drop("kept")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds; null and empty texts hold none."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents; a null text stays null when it is decoded."""
    return pieces.encode(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases and license labels of all documents; null texts have none."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from rows that are not held out; `und` without a letter."""
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components; texts without words have fingerprint zero."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots; null texts have none."""
    return variants.spelling_variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents and whether base rules and learned rules keep them; null texts have no words."""
    got = quality_rules.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents, and whether they give the text back; null texts are empty."""
    forms = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return forms.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_rules": op12_quality_rules,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": """
        WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) x(b))),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) WHERE length(r) >= 6),
        bytes AS (SELECT r, n, list_transform(range(length(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT) AS b FROM (SELECT r, count(*) AS n, hex(encode(i || ':' || r)) AS x FROM runs GROUP BY i, r)),
        hashed AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS h FROM bytes, crc),
        words AS (SELECT w AS word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS w, n FROM hashed) WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
        letters AS (SELECT array_to_string(list_transform(range(192, 256), lambda c: chr(c::INTEGER)), '') AS two, array_to_string(list_transform(range(33, 97), lambda c: chr(c::INTEGER)), '') AS one),
        singles AS (SELECT word, n, translate(word, two, one) AS s FROM words, letters),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM singles a JOIN singles b ON length(b.s) BETWEEN length(a.s) - 1 AND length(a.s) + 1
            WHERE (a.s[1:3] = b.s[1:3] OR a.s[-3:] = b.s[-3:]) AND levenshtein(a.s, b.s) = 1),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS here FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
        ends AS (SELECT c.word, c.here FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NULL)
        SELECT word, form, here AS root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op13_fill_in_middle": """
        WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        units AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed),
        ranks AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
        parts AS (
            SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
                CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM ranks),
        made AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS o FROM parts),
        marks AS (SELECT *, strpos(o, '<P>') AS mp, strpos(o, '<S>') AS ms, strpos(o, '<M>') AS mm FROM made)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
            sha256(CASE form WHEN 'psm' THEN substr(o, mp + 3, ms - mp - 3) || substr(o, mm + 3) || substr(o, ms + 3, mm - ms - 3)
                WHEN 'spm' THEN substr(o, mp + 3, mm - mp - 3) || substr(o, mm + 3) || substr(o, ms + 3, mp - ms - 3) ELSE o END) AS restored_sha256
        FROM marks""",
}
