"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewatch.llm import license, topk
from tidewatch.llm.chat import OP10_SQL, op10_chat_format
from tidewatch.llm.decontaminate import OP4_SQL, op4_decontamination
from tidewatch.llm.license import op8_license_scan
from tidewatch.llm.lines import op6_line_dedup
from tidewatch.llm.minhash import OP7_SQL, op7_minhash_dedup
from tidewatch.llm.packing import op5_best_fit_packing
from tidewatch.llm.phrases import OP12_SQL, op12_phrases
from tidewatch.llm.pii import op2_pii
from tidewatch.llm.quality import op1_quality_knn
from tidewatch.llm.topk import op3_kdtree_topk
from tidewatch.llm.toxicity import op9_toxicity
from tidewatch.llm.warc import OP13_SQL, op13_warc_revisits
from tidewatch.llm.whiten import op11_whitening


def queries() -> dict:
    import corpus_pipeline

    own = (
        op1_quality_knn, op2_pii, op3_kdtree_topk, op4_decontamination, op5_best_fit_packing, op6_line_dedup, op7_minhash_dedup,
        op8_license_scan, op9_toxicity, op10_chat_format, op11_whitening, op12_phrases, op13_warc_revisits,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": OP10_SQL, "op12_phrases": OP12_SQL, "op13_warc_revisits": OP13_SQL, "op3_kdtree_topk": topk.OP3_SQL, "op4_decontamination": OP4_SQL, "op7_minhash_dedup": OP7_SQL, "op8_license_scan": license.oracle()}
