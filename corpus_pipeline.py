"""From documents to packed training sequences: the stages of pointweave.llm.pipeline."""

from pointweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
