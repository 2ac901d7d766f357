"""Operators for large training-data pipelines: deduplication, filters, scoring, tokens, mixing.

Nothing else in the library imports this subpackage. What tasks call travels inside the serialized
functions, so executors need no install step.
"""

from pyspark import cloudpickle

from tokenloom.llm import (
    block_join,
    bpe,
    bpe_kernel,
    byte_words,
    context_tree,
    conversation_repair,
    ctw_kernel,
    fixed_filter,
    int8_tiles,
    line_crf,
    line_features,
    merkle_manifest,
    mixture,
    ngram_join,
    repair_cyk,
    rule_ledger,
    suffix_dedup,
    url_trie,
    veb_layout,
    vector_passes,
    window_digits,
)

for _module in (block_join, bpe, bpe_kernel, byte_words, context_tree, conversation_repair, ctw_kernel, fixed_filter,
                int8_tiles, line_crf, line_features, merkle_manifest, mixture, ngram_join, repair_cyk, rule_ledger,
                suffix_dedup, url_trie, veb_layout, vector_passes, window_digits):
    cloudpickle.register_pickle_by_value(_module)
