"""Every query of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("q_sentencepiece", "q_minhash", "q_quality", "q_packing", "q_linededup", "q_lm", "q_warc", "q_tokenfile", "q_ann", "q_audio")
_loaded = [importlib.import_module(f"tracelake.llm.{m}") for m in MODULES]

QUERIES = {k: f for m in _loaded for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in _loaded for k, f in m.ORACLES.items()}
