"""From raw documents to a training mix: the stages are in tessera.llm.pipeline."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
