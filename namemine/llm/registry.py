"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from namemine.llm import op1_chat, op6_decontaminate, op7_warc
from namemine.llm.op2_simhash import op2_simhash
from namemine.llm.op3_licenses import op3_licenses
from namemine.llm.op4_passages import op4_passages
from namemine.llm.op5_importance import op5_importance
from namemine.llm.op8_quality_rules import op8_quality_rules
from namemine.llm.op9_pii import op9_pii
from namemine.llm.op10_packing import op10_packing
from namemine.llm.op11_whitening import op11_whitening
from namemine.llm.op12_target_sampling import op12_target_sampling
from namemine.llm.op13_best_fit import op13_best_fit
from namemine.llm.shipping import shipped

QUERIES = {
    "op1_chat": op1_chat.op1_chat,
    "op2_simhash": shipped(op2_simhash),
    "op3_licenses": shipped(op3_licenses),
    "op4_passages": shipped(op4_passages),
    "op5_importance": shipped(op5_importance),
    "op6_decontaminate": op6_decontaminate.op6_decontaminate,
    "op7_warc": shipped(op7_warc.op7_warc),
    "op8_quality_rules": shipped(op8_quality_rules),
    "op9_pii": shipped(op9_pii),
    "op10_packing": shipped(op10_packing),
    "op11_whitening": shipped(op11_whitening),
    "op12_target_sampling": shipped(op12_target_sampling),
    "op13_best_fit": shipped(op13_best_fit),
    "pipeline": corpus_pipeline.run,
}

#: Where SQL can't express an operator there is none; ``tests/llm`` holds a brute-force version.
ORACLE: dict[str, str] = {
    "op1_chat": op1_chat.ORACLE_SQL,
    "op6_decontaminate": op6_decontaminate.ORACLE_SQL,
    "op7_warc": op7_warc.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
