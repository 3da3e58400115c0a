"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pointweave.llm import decontamination, divergence, licenses, near_duplicates, near_vectors, packing, pipeline, quality, shuffled_shards, sketch_search, slice_search, token_counts, token_files, url_filter


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_token_counts": token_counts.query,
        "op3_best_fit_packing": packing.query,
        "op4_shuffled_shards": shuffled_shards.query,
        "op5_license_scan": licenses.query,
        "op6_minhash_near_duplicates": near_duplicates.query,
        "op7_token_files": token_files.query,
        "op8_projection_near_duplicates": near_vectors.query,
        "op9_ordinal_quality": quality.query,
        "op10_url_filter": url_filter.query,
        "op11_max_sketch_search": sketch_search.query,
        "op12_bit_sliced_top_k": slice_search.query,
        "op13_source_divergence": divergence.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_minhash_near_duplicates": near_duplicates.SQL,
        "op8_projection_near_duplicates": near_vectors.SQL,
        "op11_max_sketch_search": sketch_search.SQL,
        "op12_bit_sliced_top_k": slice_search.SQL,
        "op13_source_divergence": divergence.SQL,
    }
