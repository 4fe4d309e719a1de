"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexkit.llm import decontamination, divergence
from lexkit.llm.alignment import op13_anchor_align
from lexkit.llm.decontamination import op11_suffix_decontaminate
from lexkit.llm.divergence import op12_source_divergence
from lexkit.llm.language_model import op6_deleted_interpolation
from lexkit.llm.line_dedup import op5_set_similarity_lines
from lexkit.llm.mixing import op3_cube_mix
from lexkit.llm.near_vectors import op8_nn_descent
from lexkit.llm.neighbours import op9_adaptive_scan
from lexkit.llm.ngram_join import op10_set_relation_join
from lexkit.llm.packing import op1_hilbert_pack
from lexkit.llm.sharding import op4_external_shuffle
from lexkit.llm.substrings import op7_line_hash_dedup
from lexkit.llm.toxicity import op2_weak_supervision

REGISTRY = {f.__name__: f for f in (
    op1_hilbert_pack, op2_weak_supervision, op3_cube_mix, op4_external_shuffle,
    op5_set_similarity_lines, op6_deleted_interpolation, op7_line_hash_dedup, op8_nn_descent, op9_adaptive_scan,
    op10_set_relation_join, op11_suffix_decontaminate, op12_source_divergence, op13_anchor_align,
)}
ORACLE: dict[str, str] = {"op11_suffix_decontaminate": decontamination.ORACLE, "op12_source_divergence": divergence.ORACLE}
