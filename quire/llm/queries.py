"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import bpe, chat, license, minhash, mixing, pii, quality, secrets, toxicity, vectors

QUERIES = {
    "op8_minhash": minhash.query,
    "op9_vectors": vectors.query,
    "op4_toxicity": toxicity.query,
    "op3_pii": pii.query,
    "op6_bpe": bpe.query,
    "op5_secrets": secrets.query,
    "op1_quality": quality.query,
    "op2_chat": chat.query,
    "op10_license": license.query,
    "op7_mixing": mixing.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op8_minhash": minhash.SQL,
    "op9_vectors": vectors.SQL,
    "op1_quality": quality.SQL,
    "op2_chat": chat.SQL,
    "op10_license": license.SQL,
    "op7_mixing": mixing.SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
