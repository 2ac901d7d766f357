"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.block_join import nearest
from tokenloom.llm.bpe import encode_texts, read_vocabulary
from tokenloom.llm.context_tree import held_out, score_texts
from tokenloom.llm.conversation_repair import damaged, repair_conversations
from tokenloom.llm.line_crf import FOLDS, fit_field, score_quality
from tokenloom.llm.merkle_manifest import audit, build_manifest
from tokenloom.llm.mixture import mix_sources
from tokenloom.llm.ngram_join import ngram_join
from tokenloom.llm.rule_ledger import judged
from tokenloom.llm.secret_links import scan_secrets, shown
from tokenloom.llm.suffix_dedup import WORDS, remove_repeats
from tokenloom.llm.url_trie import judge_urls
from tokenloom.llm.vector_passes import near_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(_table(spark, sf, "documents"), with_text=False, words=WORDS)


@query
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join(_table(spark, sf, "documents"))


@query
def op3_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    scored = score_quality(docs, fit_field(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", "predicted")


@query
def op4_url_trie(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(_table(spark, sf, "pages"))


@query
def op5_vector_passes(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


@query
def op6_rule_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return judged(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "sole_rule", "sole_rows")


@query
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(_table(spark, sf, "documents"), read_vocabulary(vocabulary_path()), with_ids=False, with_decoded=False)


@query
def op8_secret_links(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown(F.col("base_spans")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@query
def op9_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_texts(_table(spark, sf, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_table(spark, sf, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_veb(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    return audit(build_manifest(_table(spark, sf, "documents"), changes={"text": lowered}, changed=hit))


@query
def op12_block_join(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_cyk_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf, "conversations")))
