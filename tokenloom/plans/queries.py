"""One registered query per operator. Reports carry scalars and fingerprints, not arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.arrays import fingerprint
from tokenloom.functions.chat import PromptOptions
from tokenloom.functions.text import PRETOKENS, WORDS, is_nonblank, json_text, pieces, strip
from tokenloom.operators import batching, chat, chunk, finetune, guards, indexing, masks, packing, turn_rows
from tokenloom.operators.encode import (
    DictionaryEncoder,
    append_end,
    build_dictionary,
    chat_special_ids,
    count_special,
)
from tokenloom.operators.merges import MergeEncoder
from tokenloom.plans import inputs as I
from tokenloom.sources import chat as chat_source
from tokenloom.sources import sinks, text, vocab
from tokenloom.sources import special as special_source
from tokenloom.staging import new_path, stage
from tokenloom.streaming.chunks import read_encoded, stream_chunks, stream_encoded
from tokenloom.streaming.packing import StreamPacker
from tokenloom.streaming.resumable import ResumablePacker

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SAMPLE = ["source", "window_id", "bin"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- sources and filters -----------------------------------------------------------------


@query
def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = text.scan_text(spark, f"{sf}/documents.parquet", "text", "parquet", keep=("doc_id",))
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query
def nonblank_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.text_variants(I.documents(spark, sf, "doc_id", "text"))
    return guards.drop_blank(rows).select("doc_id", "kind")


@query
def preview_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = guards.drop_blank(I.documents(spark, sf, "doc_id", "text"))
    return guards.preview(rows, ["doc_id"], 10).select("doc_id", F.md5("text").alias("text_md5"))


@query
def jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    lines = I.json_lines(I.documents(spark, sf, "doc_id", "text"), events)
    lines = lines.withColumn("line", strip(F.col("line")))
    return text.parse_jsonl(lines, "text").select("row_id", "kind", F.md5("text").alias("text_md5"))


@query
def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf, "doc_id")
    return indexing.shard_by_position(docs, ["doc_id"], I.SHARDS).select(
        "doc_id", F.col("shard").cast("long").alias("shard"))


@query
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in one folder per shard, every shard read back by itself."""
    docs = indexing.with_row_index(I.documents(spark, sf, "doc_id", "text"), ["doc_id"], "n")
    path = new_path(spark, "shards")
    sinks.write_shards(docs, path, I.SHARDS, "n")
    out = [sinks.read_shard(spark, path, k) for k in range(I.SHARDS)]
    return reduce(DataFrame.unionByName, out).select("doc_id", F.col("shard").cast("long").alias("shard"), F.md5("text").alias("text_md5"))


@query
def empty_guard(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf, "doc_id", "text")
    blank = docs.where(~is_nonblank(F.col("text")))

    def state(name: str, df: DataFrame) -> DataFrame:
        return df.limit(1).agg((F.count("*") == 0).alias("is_empty")).select(
            F.lit(name).alias("rows"), "is_empty")

    return state("documents", docs).unionByName(state("blank", blank))


# --- dictionaries and encoding -----------------------------------------------------------


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return build_dictionary(guards.drop_blank(I.documents(spark, sf, "doc_id", "text")))


_stored: dict[tuple[str, str], str] = {}


def _stored_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus dictionary, built and written once for a session and reused by its path."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _stored:
        path = new_path(spark, "dictionary")
        vocab.write_dictionary(_dictionary(spark, sf), path)
        _stored[at] = path
    return vocab.read_dictionary(spark, _stored[at])


def _encoder(spark: SparkSession, sf: str, **options: int) -> DictionaryEncoder:
    return DictionaryEncoder(_stored_dictionary(spark, sf), **options)


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    docs = guards.drop_blank(I.documents(spark, sf, "doc_id", "source", "text"))
    return append_end(_encoder(spark, sf).encode(docs), I.EOS_ID).select("doc_id", "source", "ids")


@query
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf)


@query
def vocab_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "dictionary")
    vocab.write_dictionary(_dictionary(spark, sf), path)
    return vocab.read_dictionary(spark, path)


@query
def pretokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf, "doc_id", "text").withColumn("p", pieces(F.col("text"), PRETOKENS))
    return docs.select(
        "doc_id", F.size("p").cast("long").alias("n_pieces"),
        F.md5(F.array_join("p", "\x1f")).alias("pieces_md5"),
        (F.array_join("p", "") == F.col("text")).alias("lossless"),
    )


@query
def encode_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select(
        "doc_id", F.size("ids").cast("long").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query
def encode_small_head(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are null or repeat, and a dictionary far beyond what the tasks are handed."""
    docs = guards.drop_blank(I.documents(spark, sf, "doc_id", "text"))
    keyed = docs.select(F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("key"), "text")
    encoded = append_end(_encoder(spark, sf, head_entries=I.SMALL_HEAD).encode(keyed), I.EOS_ID)
    return encoded.select("key", F.size("ids").cast("long").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query
def encode_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Words by a tokenizer folder's dictionary and merges; words are the pieces."""
    folder = new_path(spark, "tokenizer")
    entries, merges = vocab.read_tokenizer(spark, I.TOKENIZER)
    vocab.write_dictionary(entries, f"{folder}/vocab.json")
    vocab.write_merges(merges, f"{folder}/merges.txt")
    encoder = MergeEncoder(*vocab.read_tokenizer(spark, folder), pattern=WORDS)
    encoded = encoder.encode(I.documents(spark, sf, "doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query
def encode_special(spark: SparkSession, sf: str) -> DataFrame:
    prompts = chat.render(_grouped(spark, sf), tool_calls=False).select("conv_id", "prompt")
    special = chat_special_ids()
    prompts = stage(prompts.where(F.col("prompt").isNotNull()), "prompts")
    dictionary = build_dictionary(prompts, "prompt", special=list(special))
    encoder = DictionaryEncoder(dictionary, special=special)
    return encoder.encode(prompts, "prompt").select(
        "conv_id", F.size("ids").cast("long").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query
def special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    prompts = chat.render(_grouped(spark, sf), tool_calls=False)
    counted = count_special(prompts, "prompt", special_source.special_tokens(spark))
    return counted.select("id", "content", "special", "n")


# --- chunks, windows, packs --------------------------------------------------------------


def _chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", F.col("block_no").cast("long").alias("block_no"),
        F.size("input_ids").cast("long").alias("n"), fingerprint(F.col("input_ids")).alias("ids_md5"))


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf, "doc_id", "text")
    return _chunk_report(chunk.chunk_text(
        docs, _encoder(spark, sf), seq_len=I.SEQ_LEN, eos_id=I.EOS_ID, min_len=I.MIN_LEN))


@query
def training_path(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and as Parquet, then from those files to training blocks."""
    docs = I.documents(spark, sf, "text")
    encoder = _encoder(spark, sf)

    def blocks(kind: str, path: str) -> DataFrame:
        found = chunk.training_chunks(spark, path, encoder, seq_len=I.SEQ_LEN, eos_id=I.EOS_ID, min_len=I.MIN_LEN,
                                      dataset_type=kind)
        return found.select(
            F.lit(kind).alias("format"), F.col("block_no").cast("long").alias("block_no"),
            F.size("input_ids").cast("long").alias("n"), fingerprint(F.col("input_ids")).alias("ids_md5"))

    lines, table = new_path(spark, "training-lines"), new_path(spark, "training-table")
    sinks.write_jsonl(docs, lines)
    docs.write.parquet(table)
    return blocks("jsonl", lines).unionByName(blocks("parquet", table))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts with the end id; a piece is a token, so no dictionary is needed.

    Staged, so that the passes planned on these few integers read the texts once.
    """
    docs = guards.drop_blank(I.documents(spark, sf, "doc_id", "source", "text"))
    counted = docs.select("doc_id", "source", (F.size(pieces(F.col("text"))) + 1).alias("n_tokens"))
    return stage(counted, "lengths").where(F.col("n_tokens") > 1)


def _unit_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.unit_lengths(_lengths(spark, sf), I.SEQ_LEN, I.MIN_LEN)


def _windowed(units: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    rows = packing.first_units(units, ["source", "doc_id"])
    return packing.assign_windows(rows, window_units=I.WINDOW_UNITS, shard="source",
                                  order=["doc_id"], chunk_rows=chunk_rows)


def _assignment(spark: SparkSession, sf: str) -> DataFrame:
    units = _unit_lengths(spark, sf)
    return packing.plan_bins(_windowed(units), units.select("doc_id", "block_no", "len"),
                             capacity=I.CAPACITY, min_len=I.MIN_LEN, shard="source",
                             key="doc_id", order="doc_id")


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    units = stage(chunk.split_units(_encoded(spark, sf), I.SEQ_LEN, I.MIN_LEN), "units")
    lengths = units.select("doc_id", "block_no", "len")
    plan = packing.plan_bins(_windowed(units), lengths, capacity=I.CAPACITY, min_len=I.MIN_LEN,
                             shard="source", key="doc_id", order="doc_id")
    return packing.build_samples(units, plan, key=["doc_id", "block_no"], sample=SAMPLE,
                                 order=["slot"])


@query
def pack_units(spark: SparkSession, sf: str) -> DataFrame:
    return _unit_lengths(spark, sf).select(
        "doc_id", "source", F.col("block_no").cast("long").alias("block_no"),
        F.col("len").cast("long").alias("len"))


@query
def pack_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(_unit_lengths(spark, sf)).select("source", "doc_id", "window_id")


@query
def pack_windows_chained(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows, folded over many small chunks."""
    return _windowed(_unit_lengths(spark, sf), I.SMALL_CHUNK).select("source", "doc_id", "window_id")


def _nextfit(spark: SparkSession, sf: str, chunk_rows: int | None = None) -> DataFrame:
    return packing.pack_sequential(
        _unit_lengths(spark, sf).select("source", "doc_id", "block_no", "len"),
        capacity=I.CAPACITY, shard="source", order=["doc_id", "block_no"], chunk_rows=chunk_rows)


@query
def pack_nextfit_chained(spark: SparkSession, sf: str) -> DataFrame:
    return _nextfit(spark, sf, I.SMALL_CHUNK).select(
        "source", "doc_id", F.col("block_no").cast("long").alias("block_no"), "bin")


@query
def pack_nextfit(spark: SparkSession, sf: str) -> DataFrame:
    return _nextfit(spark, sf).select(
        "source", "doc_id", F.col("block_no").cast("long").alias("block_no"), "bin")


@query
def pack_bfd(spark: SparkSession, sf: str) -> DataFrame:
    return _assignment(spark, sf).select(
        "source", "window_id", "doc_id",
        *[F.col(c).cast("long").alias(c) for c in ("block_no", "len", "bin", "slot")])


def _bin(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.col("bin").cast("long"))


@query
def pack_materialize(spark: SparkSession, sf: str) -> DataFrame:
    return _bin(_samples(spark, sf)).select(
        *SAMPLE, F.size("input_ids").cast("long").alias("n_tokens"),
        fingerprint(F.col("input_ids")).alias("ids_md5"),
        fingerprint(F.col("position_ids")).alias("positions_md5"),
        fingerprint(F.col("segments.start")).alias("starts_md5"))


def _padded_report(samples: DataFrame) -> DataFrame:
    return _bin(samples).select(
        *SAMPLE, F.size("input_ids").cast("long").alias("width"),
        fingerprint(F.col("input_ids")).alias("ids_md5"),
        fingerprint(F.col("labels")).alias("labels_md5"),
        fingerprint(F.col("position_ids")).alias("positions_md5"),
        fingerprint(F.col("attention_mask")).alias("mask_md5"))


@query
def pack_padded(spark: SparkSession, sf: str) -> DataFrame:
    return _padded_report(packing.packed_dataset(
        _encoded(spark, sf), seq_len=I.SEQ_LEN, window_units=I.WINDOW_UNITS, capacity=I.CAPACITY,
        min_len=I.MIN_LEN, pad_id=I.PAD_ID, shard="source", key="doc_id"))


def _loose_keys(encoded: DataFrame) -> DataFrame:
    """One source without a name, and keys that repeat."""
    return encoded.select(F.nullif("source", F.lit("src0")).alias("source"),
                          (F.col("doc_id") % 50).alias("doc_id"), "ids")


@query
def pack_loose_keys(spark: SparkSession, sf: str) -> DataFrame:
    """No token is lost or made where the shard is null and keys repeat."""
    samples = packing.packed_dataset(
        _loose_keys(_encoded(spark, sf)), seq_len=I.SEQ_LEN, window_units=I.WINDOW_UNITS, capacity=I.CAPACITY,
        min_len=I.MIN_LEN, pad_id=I.PAD_ID, shard="source", key="doc_id")
    used = F.aggregate("attention_mask", F.lit(0), lambda total, bit: total + bit)
    ids = F.aggregate("input_ids", F.lit(0).cast("long"), lambda total, i: total + i)
    return samples.groupBy("source").agg(F.sum(used).alias("n_tokens"), F.sum(ids).alias("id_sum"))


@query
def collate_loose_keys(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.split_blocks(_loose_keys(_encoded(spark, sf)), I.SEQ_LEN, I.MIN_LEN)
    out = batching.training_batches(chunks, I.BATCH, key=["doc_id", "block_no"], shard="source", pad_id=I.PAD_ID)
    used = F.aggregate("attention_mask", F.lit(0), lambda total, bit: total + bit)
    ids = F.aggregate("input_ids", F.lit(0).cast("long"), lambda total, i: total + i)
    return out.groupBy("source").agg(F.count("*").alias("rows"), F.sum(used).alias("n_tokens"), F.sum(ids).alias("id_sum"),
                                     (F.max("batch_id") + 1).alias("batches"))


@query
def pack_summary(spark: SparkSession, sf: str) -> DataFrame:
    sizes = packing.sample_lengths(_assignment(spark, sf), SAMPLE, I.MIN_LEN)
    return packing.summarize(sizes, I.CAPACITY, "best_fit")


@query
def pack_first_samples(spark: SparkSession, sf: str) -> DataFrame:
    sizes = packing.sample_lengths(_assignment(spark, sf), SAMPLE, I.MIN_LEN)
    return packing.first_samples(_bin(sizes), SAMPLE)


@query
def pack_compare(spark: SparkSession, sf: str) -> DataFrame:
    best = packing.sample_lengths(_assignment(spark, sf), SAMPLE, I.MIN_LEN)
    following = packing.sample_lengths(_nextfit(spark, sf), ["source", "bin"], 0)
    return packing.compare(packing.summarize(following, I.CAPACITY, "sequential"),
                           packing.summarize(best, I.CAPACITY, "best_fit"))


# --- batches, masks, steps ---------------------------------------------------------------


def _chunk_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.block_lengths(_lengths(spark, sf), I.SEQ_LEN, I.MIN_LEN).select(
        "source", "doc_id", "block_no", "len")


def _batch_report(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c not in ("source",) else F.col(c)
                       for c in df.columns])


@query
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_report(batching.assign_batches(
        _chunk_lengths(spark, sf), I.BATCH, ["doc_id", "block_no"], shard="source"))


@query
def batch_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_report(batching.assign_batches(
        _chunk_lengths(spark, sf), I.BATCH, ["doc_id", "block_no"], shuffle_seed=7))


@query
def collate_batch(spark: SparkSession, sf: str) -> DataFrame:
    chunks = stage(chunk.split_blocks(_encoded(spark, sf), I.SEQ_LEN, I.MIN_LEN), "chunks")
    out = batching.training_batches(chunks, I.BATCH, key=["doc_id", "block_no"], shard="source",
                                    pad_id=I.PAD_ID)
    return out.select(
        "source", "batch_id", F.col("row_in_batch").cast("long").alias("row_in_batch"),
        F.size("input_ids").cast("long").alias("width"),
        fingerprint(F.col("input_ids")).alias("ids_md5"),
        fingerprint(F.col("labels")).alias("labels_md5"),
        fingerprint(F.col("position_ids")).alias("positions_md5"),
        fingerprint(F.col("attention_mask")).alias("mask_md5"))


def _padded(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pad_samples(_samples(spark, sf), I.CAPACITY, I.PAD_ID)


@query
def segment_index(spark: SparkSession, sf: str) -> DataFrame:
    index = masks.segment_index(F.col("position_ids"), F.col("attention_mask"))
    return _bin(_padded(spark, sf)).select(*SAMPLE, index.alias("seg")).select(
        *SAMPLE, (F.array_max("seg") + 1).cast("long").alias("n_segments"),
        fingerprint(F.col("seg")).alias("segments_md5"))


@query
def mask_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Visible pairs per segment of the mask."""
    return masks.mask_totals(masks.mask_segments(_bin(_padded(spark, sf)), SAMPLE), SAMPLE)


@query
def mask_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = masks.mask_text(_bin(_samples(spark, sf)), SAMPLE, max_samples=3)
    return lines.select(*SAMPLE, F.col("row").cast("long").alias("row"),
                        F.md5("bits").alias("bits_md5"))


@query
def step_plan(spark: SparkSession, sf: str) -> DataFrame:
    return batching.step_plan(
        _chunk_lengths(spark, sf), ["doc_id", "block_no"], batch_size=4, accumulation=8, processes=2,
        token_budget=12_000)


@query
def stage_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks dealt to three stages, each cut where its token budget ends."""
    cut = batching.stage_cut(_chunk_lengths(spark, sf), ["doc_id", "block_no"], I.STAGE_BUDGETS)
    return _batch_report(cut.drop("stage")).join(
        cut.select("doc_id", "block_no", "stage", "start"), ["doc_id", "block_no", "start"])


@query
def stage_plan(spark: SparkSession, sf: str) -> DataFrame:
    cut = batching.stage_cut(_chunk_lengths(spark, sf), ["doc_id", "block_no"], I.STAGE_BUDGETS)
    return batching.stage_plan(cut, tokens_per_update=1000)


@query
def batch_permuted(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled batches by a permutation of row numbers."""
    numbered = stage(indexing.with_row_index(_chunk_lengths(spark, sf), ["doc_id", "block_no"], "n"), "numbered")
    return _batch_report(batching.permute_batches(numbered, I.BATCH, "n", numbered.count(), seed=7).drop("n"))


@query
def write_counted(spark: SparkSession, sf: str) -> DataFrame:
    """What a writing job counts on its way."""
    docs = guards.drop_blank(I.documents(spark, sf, "doc_id", "text"))
    counts = sinks.write_counted(docs, new_path(spark, "counted"), {"chars": F.sum(F.length("text")).cast("long"), "last_id": F.max("doc_id")})
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


# --- fine-tuning rows --------------------------------------------------------------------


def _sft(spark: SparkSession, sf: str) -> DataFrame:
    return I.sft_rows(I.documents(spark, sf, "doc_id", "text", "lang", "source"))


@query
def sft_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sft(spark, sf).drop("doc_id")
    as_json, as_parquet = new_path(spark, "sft-json"), new_path(spark, "sft-parquet")
    rows.write.json(as_json)
    rows.write.parquet(as_parquet)

    def report(kind: str, dataset_type: str, path: str) -> DataFrame:
        read = chat_source.read_sft_rows(spark, path, dataset_type)
        fields = [F.coalesce(F.array_join("messages.content", "|"), F.lit("-"))]
        fields += [F.coalesce(F.col(c), F.lit("-")) for c in read.columns[1:]]
        return read.select(F.lit(kind).alias("format"), F.md5(F.concat_ws("~", *fields)).alias("row_md5"))

    return report("json", "jsonl", f"{as_json}/*.json").unionByName(report("parquet", "parquet", as_parquet))


@query
def sft_format(spark: SparkSession, sf: str) -> DataFrame:
    return finetune.format_rows(_sft(spark, sf)).select(
        "doc_id", F.md5("prompt").alias("prompt_md5"),
        F.array_join("errors", ";").alias("problem"))


@query
def sft_rich(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with content parts, reasoning, tool calls, numbers and booleans, from JSON lines and Parquet."""
    rows = I.rich_sft_rows(I.documents(spark, sf, "doc_id", "text", "source", "n_chars"))
    lines, table = new_path(spark, "rich-lines"), new_path(spark, "rich-table")
    sinks.write_jsonl(rows, lines)
    rows.write.parquet(table)

    def prompts(kind: str, path: str) -> DataFrame:
        read = chat_source.read_sft_rows(spark, path, kind, text_column="body")
        return finetune.format_rows(read, "body").select(F.lit(kind).alias("format"), F.md5("prompt").alias("prompt_md5"))

    return prompts("jsonl", lines).unionByName(prompts("parquet", table))


@query
def sft_truncate(spark: SparkSession, sf: str) -> DataFrame:
    prompts = finetune.format_rows(_sft(spark, sf)).where(F.col("prompt").isNotNull())
    prompts = stage(prompts.select("doc_id", "prompt"), "sft-prompts")
    encoder = DictionaryEncoder(build_dictionary(prompts, "prompt"))
    return finetune.tokenize_prompts(prompts, encoder, 64).select(
        "doc_id", F.size("ids").cast("long").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


# --- conversations -----------------------------------------------------------------------


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return chat.group_turns(I.conversations(spark, sf), "conv_id", "turn")


def _prompt_report(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.length("prompt").cast("long").alias("n"),
                     F.md5("prompt").alias("prompt_md5"))


@query
def last_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns_with_responses(I.conversations(spark, sf))
    return chat.last_query_turn(turns, "conv_id", "turn")


@query
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_report(chat.render(_grouped(spark, sf), tool_calls=False))


@query
def render_responses(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns_with_responses(I.conversations(spark, sf))
    return _prompt_report(chat.render(chat.group_turns(turns, "conv_id", "turn"), tool_calls=False))


@query
def render_genprompt(spark: SparkSession, sf: str) -> DataFrame:
    grouped = _grouped(spark, sf)
    outs = [
        _prompt_report(chat.render(
            grouped, PromptOptions(add_generation_prompt=True, enable_thinking=on), tool_calls=False,
        )).withColumn("thinking", F.lit(on))
        for on in (True, False)
    ]
    return outs[0].unionByName(outs[1])


@query
def prompt_manifest(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("chat-"), F.col("conv_id").cast("string")))
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    source = new_path(spark, "manifest-samples")
    _grouped(spark, sf).repartitionByRange("conv_id").sortWithinPartitions("conv_id").select(
        given.alias("id"), messages.alias("messages")).write.json(source)
    named = chat_source.read_chat_samples(spark, source, multi_line=False)
    named = named.withColumn("id", sinks.sample_id(F.col("id"), F.col("list_index")))
    path = new_path(spark, "prompts")
    sinks.write_prompts(chat.render(named, tool_calls=False), path)
    listed = spark.read.schema("id string, output string").json(f"{path}/manifest")
    prompts = spark.read.parquet(f"{path}/prompts")
    return listed.join(prompts, "id").select(
        "id", F.regexp_extract("output", "([^/]+)$", 1).alias("file_name"),
        F.md5("prompt").alias("prompt_md5"))


@query
def think_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.thinking_variants(I.conversations(spark, sf))
    return chat.thinking(rows).select(
        "conv_id", "turn", "kind", F.md5("reasoning").alias("reasoning_md5"),
        F.md5("answer").alias("answer_md5"))


@query
def render_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    grouped = chat.group_turns(I.conversations(spark, sf), "conv_id", "turn", I.call_message())
    return _prompt_report(chat.render(grouped))


@query
def render_tool_results(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.turns_with_tools(I.conversations(spark, sf))
    return _prompt_report(chat.render(chat.group_turns(turns, "conv_id", "turn"), tool_calls=False))


@query
def render_tools(spark: SparkSession, sf: str) -> DataFrame:
    with_tools = _grouped(spark, sf).withColumn("tools", I.tool_list())
    return _prompt_report(chat.render(with_tools, tools="tools", tool_calls=False))


@query
def json_indent(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as JSON text with four columns of indent."""
    turn = F.struct("turn", "role", "text")
    listed = I.conversations(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = listed.select("conv_id", F.to_json(F.struct("conv_id", "turns"), {"ignoreNullFields": "false"}).alias("json"))
    spelled = json_text(F.col("json"), ensure_ascii=False, indent=4)
    return whole.select("conv_id", spelled.alias("t")).select(
        "conv_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


@query
def content_normalize(spark: SparkSession, sf: str) -> DataFrame:
    grouped = chat.group_turns(I.conversations(spark, sf), "conv_id", "turn", I.media_message())
    return chat.normalize_content(grouped).select(
        "conv_id", F.md5(F.array_join("contents", "|")).alias("contents_md5"))


@query
def media_count(spark: SparkSession, sf: str) -> DataFrame:
    grouped = chat.group_turns(I.conversations(spark, sf), "conv_id", "turn", I.media_message())
    return chat.number_media(grouped).select(
        "conv_id", F.md5(F.array_join("contents", "|")).alias("contents_md5"))


@query
def render_media(spark: SparkSession, sf: str) -> DataFrame:
    grouped = chat.group_turns(I.conversations(spark, sf), "conv_id", "turn", I.media_message())
    return _prompt_report(chat.render(grouped, PromptOptions(add_vision_id=True), tool_calls=False))


@query
def render_turn_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tool runs, a row for each turn."""
    pieces_ = turn_rows.render_turns(I.turns_with_tools(I.conversations(spark, sf)), "conv_id", "turn")
    return pieces_.select("conv_id", "turn", F.length("piece").cast("long").alias("n"), F.md5("piece").alias("piece_md5"))


@query
def render_turn_media(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures and videos numbered through the conversation, a row for each turn."""
    pieces_ = turn_rows.render_turns(I.conversations(spark, sf), "conv_id", "turn", I.media_message(), PromptOptions(add_vision_id=True))
    return pieces_.select("conv_id", "turn", F.length("piece").cast("long").alias("n"), F.md5("piece").alias("piece_md5"))


@query
def chat_validate(spark: SparkSession, sf: str) -> DataFrame:
    checked = chat.validate(I.broken_conversations(_grouped(spark, sf)))
    return checked.select("conv_id", "kind", F.array_join("errors", ";").alias("problem"))


def _exported_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as chat samples and read back through the sample reader."""
    grouped = _grouped(spark, sf)
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    last = F.element_at("messages", -1)["content"]
    expected = F.struct(
        F.array(F.regexp_extract(last, r"^[^ \t\r\n]+", 0), F.lit(".")).alias("must_include"),
        F.lit(40).cast("long").alias("min_chars"), F.lit(400).cast("long").alias("max_chars"),
        F.struct(F.lit("lookup").alias("name"),
                 F.concat(F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(', "deep": [1]}')).alias("args"),
                 ).alias("tool_call"))
    path = new_path(spark, "chat-samples")
    grouped.select(F.col("conv_id").cast("string").alias("id"), messages.alias("messages"),
                   expected.alias("expected")).write.json(path)
    return chat_source.read_chat_samples(spark, path, multi_line=False)


@query
def chat_samples(spark: SparkSession, sf: str) -> DataFrame:
    rendered = chat.render(_exported_samples(spark, sf), tools="tools")
    return rendered.select(
        "id", F.length("prompt").cast("long").alias("n"), F.md5("prompt").alias("prompt_md5"))


@query
def expectation_check(spark: SparkSession, sf: str) -> DataFrame:
    samples = _exported_samples(spark, sf)
    answers = samples.select(
        "id", F.element_at("messages", -1)["content"].alias("answer"),
        F.lit("lookup").alias("tool_name"),
        F.concat(F.lit('{"deep":[1],"conv":'), F.when(F.col("id") % 3 == 0, F.lit("-1")).otherwise(F.col("id")),
                 F.lit("}")).alias("tool_args"))
    return chat.check_expectations(samples, answers)


# --- streaming ---------------------------------------------------------------------------


def _document_stream(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """The table's files as they arrive; it may be one file or a folder of them."""
    path = f"{sf}/documents.parquet"
    return text.stream_text(spark, path, "text", "parquet", spark.read.parquet(path).schema, keep=keep)


@query
def stream_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _document_stream(spark, sf, "doc_id")
    return _streamed(spark, rows, _encoder(spark, sf))


@query
def stream_small_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = _document_stream(spark, sf, "doc_id")
    return _streamed(spark, rows, _encoder(spark, sf, head_entries=I.SMALL_HEAD))


def _streamed(spark: SparkSession, rows: DataFrame, encoder: DictionaryEncoder) -> DataFrame:
    path = new_path(spark, "stream-chunks")
    stream_chunks(rows, encoder, path, new_path(spark, "stream-chunks-log"), seq_len=I.SEQ_LEN,
                  eos_id=I.EOS_ID, min_len=I.MIN_LEN).awaitTermination()
    return _chunk_report(spark.read.parquet(path))


@query
def stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    packer = StreamPacker(
        spark, _encoder(spark, sf), output=new_path(spark, "stream-samples"),
        state=new_path(spark, "stream-state"), seq_len=I.SEQ_LEN, window_units=I.WINDOW_UNITS,
        capacity=I.CAPACITY, eos_id=I.EOS_ID, pad_id=I.PAD_ID, shard="source", key="doc_id",
        min_len=I.MIN_LEN)
    samples = packer.run(_document_stream(spark, sf, "doc_id", "source"),
                         new_path(spark, "stream-log"))
    return _padded_report(samples)


@query
def stream_pack_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus arrives in two parts; the queries end between them and go on from their checkpoints.

    One query encodes, whatever the dictionary's size, the other packs the rows with their ids.
    """
    docs = I.documents(spark, sf, "doc_id", "source", "text")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).cast("long")).first()[0]
    folder, encoded, output, log = (new_path(spark, f"resumed-{name}") for name in ("in", "ids", "out", "log"))
    encoder = _encoder(spark, sf)
    for part, some in enumerate((F.col("doc_id") <= middle, F.col("doc_id") > middle)):
        docs.where(some).write.parquet(f"{folder}/part-{part}")
        packer = ResumablePacker(
            spark, encoder, output=output, checkpoint=f"{log}/pack", seq_len=I.SEQ_LEN, window_units=I.WINDOW_UNITS,
            capacity=I.CAPACITY, eos_id=I.EOS_ID, pad_id=I.PAD_ID, shard="source", key="doc_id", min_len=I.MIN_LEN)
        arriving = text.stream_text(spark, folder, "text", "parquet", docs.schema, keep=("doc_id", "source"))
        stream_encoded(arriving, encoder, encoded, f"{log}/encode").awaitTermination()
        packer.start_encoded(read_encoded(spark, encoded, docs.select("doc_id", "source").schema)).awaitTermination()
    return _padded_report(packer.samples())
