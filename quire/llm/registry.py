"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quire.llm.ann import op4_balanced_postings
from quire.llm.bpe_count import op10_token_counts
from quire.llm.jaccard import op6_ngram_jaccard
from quire.llm.langid import op5_language_id
from quire.llm.lattice_lm import op8_lattice_lm
from quire.llm.line_quality import ORACLE as LINE_QUALITY
from quire.llm.line_quality import op2_line_quality
from quire.llm.packing import op3_best_fit_packing
from quire.llm.pii import op11_pii
from quire.llm.phrases import ORACLE as PHRASES
from quire.llm.phrases import op13_phrases
from quire.llm.ranked_search import ORACLE as RANKED_SEARCH
from quire.llm.ranked_search import op12_ranked_search
from quire.llm.toxicity import op9_toxicity
from quire.llm.warc import ORACLE as WARC
from quire.llm.warc import op1_warc_segments
from quire.llm.wfst import op7_sentencepiece_wfst


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_segments, op2_line_quality, op3_best_fit_packing, op4_balanced_postings, op5_language_id, op6_ngram_jaccard, op7_sentencepiece_wfst, op8_lattice_lm, op9_toxicity, op10_token_counts, op11_pii, op12_ranked_search, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_segments": WARC, "op2_line_quality": LINE_QUALITY, "op12_ranked_search": RANKED_SEARCH, "op13_phrases": PHRASES}
