"""The corpus pipeline: toxicity, language, near-duplicates, secrets, packing (see tidemark/llm/pipeline.py)."""
from tidemark.llm.pipeline import CLEAR, ORACLE_SQL, STAGES, TOXIC, drop_toxic, keep_clear_language, keep_one_of_near_copies, pack, redact_secrets, run

__all__ = ["CLEAR", "ORACLE_SQL", "STAGES", "TOXIC", "drop_toxic", "keep_clear_language", "keep_one_of_near_copies", "pack", "redact_secrets", "run"]
