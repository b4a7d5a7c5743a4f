"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import binary, codes, digest, exact, language, neardup, negatives, packing, pieces, pii, sharding, toxicity, urls
from tableflow.llm.common import fold
from tableflow.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark, sf_dir):
    """Language of all documents, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    return language.identify(docs, model, fold("doc_id", 5) == 0)


def op2_personal_data(spark, sf_dir):
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_host_reputation(spark, sf_dir):
    """All pages judged; the number in a page's path names the document whose labels it carries."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1), '') AS bigint)")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = pages.select("page_id", number.alias("doc_id")).where("doc_id IS NOT NULL").join(labels, "doc_id")
    return urls.judge(pages, outcomes.select("page_id", bad.alias("bad")))


def op4_token_files(spark, sf_dir):
    """Ids of all documents, written in frames and read back."""
    path = new_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    manifest = binary.write_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return binary.read_files(manifest)


def op5_radix_dedup(spark, sf_dir):
    """All documents with the row that stays of their group of equal texts."""
    return exact.groups(table(spark, sf_dir, "documents")).drop("row_no")


def op6_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from two thirds of the labels."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *toxicity.default_folds())
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_pieces(spark, sf_dir):
    """SentencePiece round trip of all documents."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark, sf_dir):
    """All documents packed into sequences of 2,048 tokens, each with the corpus' mixture of sources."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


def op9_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and their edited texts."""
    return digest.compare_with_next(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark, sf_dir):
    """All documents with their class of near duplicates."""
    return neardup.classes(table(spark, sf_dir, "documents")).drop("row_no")


def op11_interleaved_shards(spark, sf_dir):
    """All documents in 24 shards of equal row counts, each with the corpus' mixture of sources."""
    docs = sharding.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "text_crc32")
    dealt = sharding.interleave(docs, 24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_pivot_codes(spark, sf_dir):
    """All embeddings as codes of 16 bytes, with their errors."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    out = codes.with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding among all; every seventh label is moved on by one."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label=label)


QUERIES = {
    "op1_language": op1_language,
    "op2_personal_data": op2_personal_data,
    "op3_host_reputation": op3_host_reputation,
    "op4_token_files": op4_token_files,
    "op5_radix_dedup": op5_radix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_order_minhash": op10_order_minhash,
    "op11_interleaved_shards": op11_interleaved_shards,
    "op12_pivot_codes": op12_pivot_codes,
    "op13_hard_negatives": op13_hard_negatives,
}
