"""The registered queries of the document operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, languages, licenses, mixing, ordered, periodic, pieces, quality, secrets, simhash, suffixes, tiff, variants
from .common import documents


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public vocabularies are; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), keep_bytes=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(documents(spark, sf_dir))


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages.identify(docs, languages.learn(docs))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(documents(spark, sf_dir))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), vocabulary())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir)).drop("span_starts", "span_ends")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.near_duplicates(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.learn(docs, documents(spark, sf_dir, "labels")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(documents(spark, sf_dir))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.repeat_runs(periodic.with_planted_runs(documents(spark, sf_dir))))


def op13_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return attention.score(docs, attention.learn(docs, vocabulary("byte_bpe_multi_50k.tiktoken")))


def op2_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2: the columns that SQL can express."""
    return op2_simhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op4_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: the sizes that SQL can express."""
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6: the base counts, which SQL can express."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op10_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10: the base columns, which SQL can express."""
    return op10_licenses(spark, sf_dir).select("doc_id", "n_words", "base_labels")


#: SQL of the columns of operators that it can express; the whole operators are tested against plain loops.
SQL = {
    "part_op2_lengths": """SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)), 1, length(t) // 3)) AS edited_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "part_op4_payloads": "SELECT doc_id, n AS n_bytes, greatest(64, (n + 63) // 64 * 64) AS payload_bytes FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)",
    "part_op6_counts": r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "part_op10_words": r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, concat_ws(',', CASE WHEN contains(l, ' apache license version 2 ') THEN 'apache-2' END, CASE WHEN contains(l, ' cc by nc ') THEN 'cc-by-nc' END, CASE WHEN contains(l, ' under the mit license ') THEN 'mit' END) AS base_labels
 FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS l FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents))""",
}


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {f"part_{name}" if f"part_{name}" in SQL else name: f for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
