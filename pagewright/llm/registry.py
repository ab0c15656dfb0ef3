"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pagewright.llm import collocations, urls
from pagewright.llm.alignment import op11_token_alignment
from pagewright.llm.collocations import op13_phrase_collocations
from pagewright.llm.decontaminate import op6_decontaminate
from pagewright.llm.jaccard import op7_ngram_jaccard_join
from pagewright.llm.packing import op10_retrieval_packing
from pagewright.llm.pii import op3_pii
from pagewright.llm.quality import op9_quality_classifier
from pagewright.llm.repeats import op1_suffix_dedup
from pagewright.llm.simhash import op12_simhash_near_dedup
from pagewright.llm.telephony import op8_telephony_audio
from pagewright.llm.token_counts import op4_token_counts
from pagewright.llm.token_files import op5_token_files
from pagewright.llm.urls import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_url_filter,
        op3_pii,
        op4_token_counts,
        op5_token_files,
        op6_decontaminate,
        op7_ngram_jaccard_join,
        op8_telephony_audio,
        op9_quality_classifier,
        op10_retrieval_packing,
        op11_token_alignment,
        op12_simhash_near_dedup,
        op13_phrase_collocations,
    )
}
ORACLES: dict[str, str] = {"op2_url_filter": urls.oracle(), "op13_phrase_collocations": collocations.oracle()}
