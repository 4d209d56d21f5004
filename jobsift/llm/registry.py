"""The queries of this subpackage: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from jobsift.llm import (q_bench, q_chat, q_classifier, q_fim, q_linededup, q_lm, q_minhash,
                         q_mixing, q_phrases, q_quality, q_suffix, q_urls, q_vafile)

MODULES = [q_urls, q_mixing, q_quality, q_linededup, q_classifier, q_minhash, q_chat,
           q_bench, q_suffix, q_lm, q_phrases, q_vafile, q_fim]


def queries():
    out = {"pipeline": corpus_pipeline.run}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out |= getattr(m, "ORACLES", {})
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
