"""Registered queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogdiff.llm import (
    audit, coordinates, lexical, licences, mixing, packing, pii, quality, reputation, simhash, toxicity, warc, winnowing,
)
from catalogdiff.llm.common import new_folder, read_table

# Rows a toxicity model is fitted on, at most; the score from which a document is toxic.
TOXIC_SAMPLE, TOXIC_FROM = 20_000, 0.7
# Rules of the url filter.
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Toxicity:
    return toxicity.fit(toxicity.labelled_texts(docs, labels, TOXIC_SAMPLE), TOXIC_SAMPLE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    doc = F.col("row.doc_id")
    return toxicity.scored(docs, model).select(
        doc.alias("doc_id"),
        toxicity.held_out(doc).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    # Archives just written have no gaps; one would be a page lost, so it is not passed over.
    fault = "IF(kind = 'gap', raise_error(concat('bytes ', start, ' to ', stop, ' of ', file, ': ', reason)), record_id)"
    found = found.withColumn("record_id", F.expr(fault))
    return found.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.concat_ws(",", "notices"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        F.size(F.array_remove(F.transform(kinds, lambda k: F.when(k == number, k).otherwise(-1)), -1)).cast("bigint").alias(f"n_{kind}")
        for number, kind in enumerate(pii.BASE_KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.edited(read_table(spark, sf_dir, "documents"))
    own, other = winnowing.hashes(F.col("fingerprint")), winnowing.hashes(F.col("edited_fingerprint"))
    rows = rows.withColumns({"own": own, "other": other, "following": winnowing.hashes(F.col("next_fingerprint"))})
    return rows.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("fingerprint")).alias("fingerprint"),
        winnowing.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        winnowing.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op10_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    # A page's outcome is the label of the document of its number: good if of quality and not toxic.
    labels = read_table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")
    found = reputation.judged(pages, labels.select(F.col("doc_id").alias("page_id"), good), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coordinates.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_toxicity, op3_simhash, op4_packing, op5_warc, op6_quality, op7_licences, op8_pii, op9_winnowing,
        op10_reputation, op11_audit, op12_minhash, op13_lexical,
    )
}
