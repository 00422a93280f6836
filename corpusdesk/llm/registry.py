"""The queries of this subpackage and the SQL that checks them."""

from corpusdesk.llm.alignment import op13_token_alignment
from corpusdesk.llm.langid import op6_language_id
from corpusdesk.llm.licenses import op5_license_scan
from corpusdesk.llm.merkle import OP9_SQL, op9_document_fingerprints
from corpusdesk.llm.mixing import OP8_SQL, op8_source_mixing
from corpusdesk.llm.packing import op1_packing
from corpusdesk.llm.pii_spans import op11_pii_spans
from corpusdesk.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from corpusdesk.llm.quality import op3_quality_rules
from corpusdesk.llm.simhash import op4_simhash_dedup
from corpusdesk.llm.token_counts import op2_token_counts
from corpusdesk.llm.toxicity import op10_toxicity
from corpusdesk.llm.urlfilter import op7_url_filter

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_token_counts, op3_quality_rules, op4_simhash_dedup, op5_license_scan,
    op6_language_id, op7_url_filter, op8_source_mixing, op9_document_fingerprints, op10_toxicity,
    op11_pii_spans, op12_prefix_trie, op13_token_alignment)}
ORACLES = {"op8_source_mixing": OP8_SQL, "op9_document_fingerprints": OP9_SQL, "op12_prefix_trie": OP12_SQL}
