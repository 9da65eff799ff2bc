"""The named queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

import zlib

import public_tokenizers

from tastegrid.llm import (byte_bpe, decontam, edit_embedding, fm_index, kd_shards, lexical_search, licenses, minmax_hash,
                           periodic_runs, simhash, suffix_dedup, token_counts as counts, toxicity)
from tastegrid.llm.registry import query, table


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)


@query("op10_edit_embedding")
def op10_edit_embedding(spark, sf_dir):
    return edit_embedding.edited_likeness(table(spark, sf_dir, "documents"))


@query("op6_kd_shards")
def op6_kd_shards(spark, sf_dir):
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"), leaves=24)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_fm_index")
def op1_fm_index(spark, sf_dir):
    return fm_index.substring_dedup(table(spark, sf_dir, "documents"), width=20)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), width=200)


@query("op4_decontam", decontam.SQL)
def op4_decontam(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_licenses")
def op7_licenses(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


def planted_period(doc_id, words):
    """Rows whose id has a crc32 divisible by ten become periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), min_length=24, exponent=3, rewrite=planted_period)
    return periodic_runs.run_digests(found)


@query("op12_minmax_hash", minmax_hash.SQL)
def op12_minmax_hash(spark, sf_dir):
    return minmax_hash.near_copies(table(spark, sf_dir, "documents"), share=0.85, width=3)


@query("op13_lexical_search", lexical_search.SQL)
def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
