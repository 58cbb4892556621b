"""The operators' queries, by name, and SQL where it can say what comes out."""

from __future__ import annotations

from barloom.llm.decontaminate import op9_benchmark_decontamination
from barloom.llm.embedding_dedup import OP10_SQL, op10_inverted_multi_index
from barloom.llm.html_extract import op2_recurrent_labeller
from barloom.llm.minhash import op3_weighted_minhash
from barloom.llm.ngram_lm import op1_deleted_interpolation
from barloom.llm.packing import op5_best_fit_packing
from barloom.llm.quality import op6_compression_quality
from barloom.llm.suffix_dedup import OP7_SQL, op7_suffix_array_dedup
from barloom.llm.toxicity import op8_toxicity
from barloom.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_deleted_interpolation, op2_recurrent_labeller, op3_weighted_minhash, op4_warc, op5_best_fit_packing, op6_compression_quality,
        op7_suffix_array_dedup, op8_toxicity, op9_benchmark_decontamination, op10_inverted_multi_index
    )
}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op7_suffix_array_dedup": OP7_SQL, "op10_inverted_multi_index": OP10_SQL}
