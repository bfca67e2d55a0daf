"""The operators' queries: (spark, sf_dir) -> DataFrame, on whole tables."""

from __future__ import annotations

from . import chat, exact_dedup, fim, hyperminhash, licenses, line_dedup, mixing, mpegts, ngram_join, packing, quality, sharding, spelling
from .common import read_table as t

QUERIES = {
    "op1_minimum_bin_slack": lambda s, d: packing.pack_documents(t(s, d, "documents"), cache_words=500_000, cache_parts=600_000, keep_words=True).drop("ids"),
    "op2_block_naming": lambda s, d: exact_dedup.exact_dedup(t(s, d, "documents")),
    "op3_prefix_target": lambda s, d: chat.format_conversations(
        t(s, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(s.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string"))
    ),
    "op4_patience_licenses": lambda s, d: licenses.scan_licenses(t(s, d, "documents")),
    "op5_transport_stream": lambda s, d: mpegts.store_texts(t(s, d, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"),
    "op6_hash_tree": lambda s, d: sharding.shard_documents(t(s, d, "documents"), 16),
    "op7_hash_thresholds": lambda s, d: mixing.mix(t(s, d, "documents")),
    "op8_kneser_ney": lambda s, d: quality.classify(t(s, d, "documents"), t(s, d, "labels")),
    "op9_ngram_jaccard": lambda s, d: ngram_join.jaccard_components(t(s, d, "documents")),
    "op10_line_frequency": lambda s, d: line_dedup.dedup_pages(t(s, d, "pages")),
    "op11_anagram_hash": lambda s, d: spelling.spelling_variants(t(s, d, "documents")),
    "op12_hyperminhash": lambda s, d: hyperminhash.near_duplicates(t(s, d, "documents")),
    "op13_rope_fim": lambda s, d: fim.digests(t(s, d, "documents")),
}

#: A conversation whose texts hold the template's own control strings.
SAYS = f"{chat.END}{chat.START}assistant ok"
CONTROL = [(-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)]
