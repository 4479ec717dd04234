"""The queries of these operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path
from . import ann, bpe, chroma, dac, licenses, packing, pii, quality, simhash, urls


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three, and links by fingerprints alone."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, least=None)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        pii.sha256(F.col("base_spans")).alias("base_sha256"), "spans", "n_added",
    )


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_documents(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op4_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "dac")
    manifest = dac.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return dac.read_tokens(spark, path, manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in urls.LISTED], "key string")
    found = urls.judge(_table(spark, sf_dir, "pages"), listed)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_texts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio, so each vector is played as a melody and taken as a recording."""
    found = chroma.match(_table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), render=chroma.render_vector)
    return found.withColumnRenamed("id", "vec_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_bpe_chunks": op3_bpe_chunks,
    "op4_dac": op4_dac,
    "op5_urls": op5_urls,
    "op6_packing": op6_packing,
    "op7_chroma": op7_chroma,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_licenses": op10_licenses,
}

_PARTS = """
parts AS (
    SELECT page_id, coalesce(url, '') AS url,
        CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
cut AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts),
named AS (
    SELECT page_id, url,
        translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM cut
)"""


def _urls_sql() -> str:
    """The rules in SQL; the list by its meaning: listed hosts and their subdomains."""
    rules = sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        of, _, begin = rule.partition("/")
        return f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{begin}')"

    chosen = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    says = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    hosts = " OR ".join(f"bare = '{x[:-1]}' OR ends_with(bare, '.{x[:-1]}')" for x in urls.LISTED)
    return f"""WITH {_PARTS},
ruled AS (
    SELECT *, CASE {chosen} END AS rule,
        regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS bare
    FROM named
)
SELECT page_id, host, path, rule,
    coalesce(CASE rule {says} END, CASE WHEN {hosts} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


ORACLE_SQL: dict[str, str] = {"op5_urls": _urls_sql()}
