"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import alignment, ann, html, infill, leaks, packing, pieces, quality, secrets, simhash, tokencount, toxicity, urlfilter
from cotejo.llm.common import read_table

#: Hosts with one of these in a label are on the block list that op5 uses.
LISTED_WORDS = ("spam", "adult", "bets", "casino", "malware", "phish", "warez")
URL_RULES = [
    urlfilter.Rule("com/en/", "block"),
    urlfilter.Rule("example.com/en/7", "allow"),
    urlfilter.Rule("net/de/", "allow"),
    urlfilter.Rule("example.net/de/8", "block"),
    urlfilter.Rule("org/es/", "block"),
]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and the smallest document it is linked with."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs)
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the best segmentation, the scores of the four best, and the round trip."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.segment(docs, model, n=4)
    text = F.coalesce("row.text", F.lit(""))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.get("scores", F.lit(0)).alias("score"),
        F.concat_ws(",", F.col("scores").cast("array<string>")).alias("nbest_scores"),
        F.xxhash64("ids").alias("ids_hash"), F.xxhash64("edits").alias("edits_hash"),
        (pieces.decoder(model)("ids") == text).alias("round_trip"),
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base secrets (counts and digest) and all reported spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.col("parts")

    def of(kind: int):
        return F.size(F.filter(parts, lambda x: x["k"] == kind)).cast("long")

    base = F.filter(parts, lambda x: x["k"] < 3)
    return secrets.scan_secrets(docs).select(
        F.col("row.doc_id").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(parts).alias("spans"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: figures, the base rules and the verdict with its host's."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = quality.quality_rules(docs, slim=("doc_id",))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), *[F.col("fig")[k].alias(k) for k in quality.FIGURES[:5]], "base_failed", "kept"
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that decides (if any) and the verdict."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(urlfilter.url_host(F.col("url")).alias("key")).distinct()
    listed = hosts.filter(F.col("key").rlike("|".join(LISTED_WORDS)))
    out = urlfilter.filter_urls(pages, listed, URL_RULES)
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth vector."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("id") % 50 == 0)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its visible text and the lines of it."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    out = html.extract_text(pages)
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return out.select(F.col("row.page_id").alias("page_id"), "text", F.char_length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether it has more than 1024 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: its place in its document and in its sequence."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def held_out(id) -> Column:
    """A fifth of the ids, by their CRC-32 as text; a null id counts as an empty text and is one of them."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the score of a classifier trained on labels outside the held-out fifth."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))
    out = toxicity.score_documents(docs, model)
    return out.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, groups and links of two tokenizers, and how common its links are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    figures = found.select("row.doc_id", "at", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs")
    return alignment.add_agreement(figures).drop("at")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its units, its form and digests of the output and of the text rebuilt from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = infill.fill_in_middle(docs, keep=("doc_id",))
    return out.select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words inside passages of benchmark items, and the items they come from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = leaks.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return out.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scans": op3_secret_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}
