"""The contract queries of the training-data operators."""

from __future__ import annotations

#: Query name -> (module, function); functions take (spark, sf_dir).
_QUERIES = {
    "op1_token_orc": "op1",
    "op2_license_scan": "op2",
    "op3_jaccard_join": "op3",
    "op4_chat_tree": "op4",
    "op5_quality": "op5",
    "op6_lz_fingerprint": "op6",
    "op7_packing": "op7",
    "op8_mixing": "op8",
    "op9_toxicity": "op9",
    "op10_audio_prints": "op10",
}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark, sf_dir):
    from .common import read
    from .op01_token_orc import token_orc_digest

    return token_orc_digest(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op2(spark, sf_dir):
    from .common import read
    from .op02_license import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op3(spark, sf_dir):
    from .common import read
    from .op03_jaccard_join import near_duplicate_groups

    return near_duplicate_groups(read(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    from pyspark.sql import functions as F

    from .common import read
    from .op04_chat_tree import chat_digest

    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(rows.unionByName(more), public_path("byte_bpe_50k.json"))


def op5(spark, sf_dir):
    from .common import read
    from .op05_quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6(spark, sf_dir):
    from .common import read
    from .op06_lz_fingerprint import neighbour_likeness

    return neighbour_likeness(read(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    from .common import read
    from .op07_packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


#: Shares of all tokens that the mixture gives to the domains.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_domains(docs, labels):
    """The domain (language) of the labelled documents."""
    return docs.select("doc_id", docs["lang"].alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op8(spark, sf_dir):
    from .common import read
    from .op08_mixing import mixture_report

    docs = read(spark, sf_dir, "documents")
    return mixture_report(docs, labelled_domains(docs, read(spark, sf_dir, "labels")), TARGETS)


def op9(spark, sf_dir):
    from .common import read
    from .op09_toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10(spark, sf_dir):
    from .common import read
    from .op10_audio import audio_digest

    return audio_digest(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: globals()[f] for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it expresses; the others are tested against
    brute force, round trips and held-out rows."""
    from .oracles import OP3, OP4, license_scan_sql

    return {"op2_license_scan": license_scan_sql(), "op3_jaccard_join": OP3, "op4_chat_tree": OP4}
