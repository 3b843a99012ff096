"""Named queries of this subpackage and, where SQL can express them, their statements."""

from __future__ import annotations

from strata_spark.llm.decontaminate import op2_decontaminate
from strata_spark.llm.fingerprint import op1_fingerprint
from strata_spark.llm.lexical_search import OP12_SQL, op12_lexical_search
from strata_spark.llm.licenses import op10_license_scan
from strata_spark.llm.line_dedup import OP7_SQL, op7_line_dedup
from strata_spark.llm.merkle import OP11_SQL, op11_merkle_manifest
from strata_spark.llm.mixing_lm import op6_lm_score
from strata_spark.llm.ngram_join import OP5_SQL, op5_ngram_join
from strata_spark.llm.packing import op8_packing
from strata_spark.llm.pii import op3_pii
from strata_spark.llm.token_counts import op4_token_counts
from strata_spark.llm.toxicity import op9_toxicity
from strata_spark.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_lm_score": op6_lm_score,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}

ORACLES = {
    "op5_ngram_join": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_warc": OP13_SQL,
}
