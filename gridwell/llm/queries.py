"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import licenses, manifest, repeats, topk
from .alignment import op12_alignment
from .bpe import op10_bpe
from .jaccard import op11_jaccard
from .language import op8_language
from .licenses import op7_licenses
from .manifest import op13_manifest
from .media import op1_media_columns
from .packing import op5_packing
from .quality import op2_quality
from .repeats import op9_repeats
from .simhash import op6_simhash
from .topk import op3_topk
from .toxicity import op4_toxicity


def queries() -> dict:
    import corpus_pipeline

    operators = (op1_media_columns, op2_quality, op3_topk, op4_toxicity, op5_packing, op6_simhash, op7_licenses, op8_language, op9_repeats, op10_bpe, op11_jaccard, op12_alignment, op13_manifest)
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return licenses.ORACLES | manifest.ORACLES | repeats.ORACLES | topk.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
