"""The queries of this subpackage and, where SQL can say the same, their DuckDB forms."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .collocations import OP13_SQL, op13_phrase_collocations
from .decontamination import op6_benchmark_decontamination
from .fingerprints import op4_document_fingerprints
from .jaccard import op2_ngram_jaccard_join
from .mixing import op8_mixing_sources
from .oracles import OP2_SQL, OP6_SQL, OP10_SQL
from .packing import op12_mixture_packing
from .quality import op9_quality_classifier
from .secrets import op3_secret_scan
from .spelling import OP11_SQL, op11_spelling_variants
from .substrings import op10_substring_dedup
from .tokens import op7_token_counts
from .warc import OP5_SQL, op5_warc


def queries() -> dict:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_secret_scan": op3_secret_scan,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_warc": op5_warc,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_token_counts": op7_token_counts,
        "op8_mixing_sources": op8_mixing_sources,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_mixture_packing": op12_mixture_packing,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_ngram_jaccard_join": OP2_SQL,
        "op5_warc": OP5_SQL,
        "op6_benchmark_decontamination": OP6_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
