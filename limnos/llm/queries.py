"""The operators applied to the whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op9_pack_windows")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of at most 1024 ids."""
    from limnos.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to bit-plane token files in doc_id order and read back."""
    from limnos.llm.bitplane import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT rid, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT rid, k, dw.size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


@register("op8_benchmark_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against every 10-word window of the benchmark."""
    from limnos.llm.decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    from limnos.llm.pii import BASE_KINDS, find_spans, joined

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")

    def count(kind: str):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("pii", lambda x: x["rank"] < len(BASE_KINDS)))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(base, 256).alias("base_sha256"),
                        joined(F.col("pii")).alias("spans"))


@register("op3_shard_bytes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, copies together."""
    from limnos.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op6_repeated_units")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of whole sentences (15 words at least) in all documents, but its earliest occurrence."""
    from limnos.llm.substring_dedup import repeated_units

    return repeated_units(table(spark, sf_dir, "documents"), "sentence", 15)


@register("op4_ngram_jaccard")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard 0.8 of 5-word shingles."""
    from limnos.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the labelled ones that are not held out."""
    from limnos.llm.langid import predict, train
    from limnos.llm.runtime import crc_mod

    docs = table(spark, sf_dir, "documents")
    learn = docs.where((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull()).select(
        "doc_id", "text", F.col("lang").alias("label"))
    found = predict(docs, train(learn))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    from limnos.llm.runtime import crc_mod
    from limnos.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op5_nearest_vectors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    from limnos.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), 10)


@register("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the class of each under Hamming radius 5."""
    from limnos.llm.runtime import cut_lineage
    from limnos.llm.simhash import edit_likeness, near_classes

    rows = cut_lineage(edit_likeness(table(spark, sf_dir, "documents")))
    return rows.join(near_classes(rows), "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id")


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened coordinates of all embeddings on up to 16 components, a row per vector and component."""
    from limnos.llm.whitening import whiten

    found, model = whiten(table(spark, sf_dir, "embeddings"), components=16)
    share = F.array(*map(F.lit, model.explained if model else [])).cast("array<double>")
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                       "deviation", "whitened", share[F.col("at")].alias("explained"),
                       F.lit(model.identity_error if model else 0.0).alias("identity_error"))


@register("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by crc32 of conv_id:turn, and the cheapest repair of each."""
    from limnos.llm.conversations import damage, repair

    rows = damage(table(spark, sf_dir, "conversations"))
    return repair(rows, present=rows["present"])
