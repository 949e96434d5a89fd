"""Queries of the training-data operators, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from . import decontam, hmm, lattice, linededup, mixing, ngramjoin, pagediff, tokenio, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_lattice_dedup": lattice.op3,
    "op4_ngram_jaccard": ngramjoin.op4,
    "op5_hmm_scores": hmm.op5,
    "op6_line_dedup": linededup.op6,
    "op7_decontamination": decontam.op7,
    "op8_token_blocks": tokenio.op8,
    "op9_page_diff": pagediff.op9,
    "op10_warc": warc.op10,
}
ORACLES: dict[str, str] = {"op4_ngram_jaccard": ngramjoin.ORACLE, "op6_line_dedup": linededup.ORACLE}
