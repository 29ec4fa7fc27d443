"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import merkle, pii, runs, secrets
from tessera.llm.common import count_kind, joined_spans, of_kinds, read_table
from tessera.llm.decontam import decontaminate, near_documents
from tessera.llm.exact_dedup import list_duplicates
from tessera.llm.jaccard_join import components
from tessera.llm.page_text import extract_text
from tessera.llm.pieces import encode_pieces
from tessera.llm.quality import KEEP_AT, score_documents, train
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_files import read_tokens, write_tokens
from tessera.llm.urls import canonical_url, judge_urls
from tessera.session import intermediate_folder

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
END_ID = 2
RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
# Host labels of the test pages whose canonical URLs form the block list.
LISTED_HOSTS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def _digests(spans: str, base: tuple[str, ...]) -> list:
    column = F.col(spans)
    return [
        "doc_id",
        *[count_kind(column, k).alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(of_kinds(column, base)), 256).alias("base_sha256"),
        joined_spans(column).alias("spans"),
    ]


@register
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents")).select(*_digests("spans", pii.BASE))


@register
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{intermediate_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE), END_ID)
    return read_tokens(spark, folder)


@register
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary_words() -> list[str]:
    """Words of two public vocabularies, many of them common to code, the English one first."""
    with open(public_tokenizers.path(WORD_BPE), encoding="utf-8") as file:
        words = [w.removesuffix("</w>") for w in json.load(file)["model"]["vocab"]]
    with open(public_tokenizers.path(MULTI_BPE), "rb") as file:
        pieces = [base64.b64decode(line.split()[0]).strip() for line in file if line.strip()]
    return words + [p.decode() for p in pieces if p.isascii()]


@register
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"), vocabulary_words())
    return found.select(*_digests("spans", secrets.BASE))


@register
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_duplicates(read_table(spark, sf_dir, "documents"))


@register
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


@register
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).withColumn("kept", F.col("p_good") >= KEEP_AT)


@register
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.select(canonical_url(F.col("url")).alias("url")).where(
        F.regexp_extract("url", "^[^/?]*", 0).rlike("|".join(rf"(^|\.){h}\." for h in LISTED_HOSTS))
    )
    return judge_urls(pages, RULES, listed)


@register
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_table(spark, sf_dir, "documents"))


@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@register
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


@register
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf folded up to the root; rows picked by their id's checksum are tampered with."""
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = [more if name == "n_chars" else F.col(name) for name in merkle.COLUMNS]
    tampered = F.when(picked & F.col("n_chars").isNotNull(), merkle.leaf_digest(changed))
    manifest = merkle.build_manifest(read_table(spark, sf_dir, "documents"), further={"tampered": tampered})
    folded = merkle.folded(F.coalesce("further.tampered", "leaf"), F.col("path"))
    return merkle.proofs(manifest).select(
        F.col("order").alias("doc_id"),
        merkle.as_hex(F.col("leaf")).alias("leaf"),
        merkle.as_hex(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).alias("root"),
        merkle.as_hex(merkle.path_digest(F.col("path"))).alias("proof_sha256"),
        merkle.as_hex(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from a on repeat with period p."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), checksum.alias("h"))
    picked = rows.where("h % 10 = 0").select(
        "doc_id", "text", F.expr("h div 10").alias("g"), runs.words_of(F.col("text")).alias("words")
    )
    shifts = picked.withColumn("n", F.size("words")).withColumn("a", F.expr("int(g % greatest(n, 1))"))
    shifts = shifts.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    period = F.expr("slice(words, a + 1, p)")
    times = F.expr("int((n - a) div p + 1)")
    repeated = F.slice(F.flatten(F.array_repeat(period, times)), 1, F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), repeated), " ")
    return (
        rows.where("h % 10 <> 0 OR h IS NULL")
        .select("doc_id", "text")
        .unionByName(shifts.select("doc_id", F.when(F.col("n") > 0, planted).otherwise("").alias("text")))
    )


@register
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches beside op10_decontamination, whose columns its SQL fixes."""
    found = near_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_near", F.array_join("near_items", ",").alias("near_items"))


# Second queries of an operator, without SQL.
FURTHER: dict[str, Query] = {"op10_near": op10_near}
