"""Imports every module of the subpackage that registers queries."""

from trawlframe.llm import (  # noqa: F401
    anchor_pii, certified_packing, chosen_path, collision_projections, huffman_ids, identity_alignment, impact_search, line_runs, multi_index, pair_index_bpe,
    pu_toxicity, temperature_mix, text_density)
