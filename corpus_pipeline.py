"""The training-data pipeline: five stages over documents. They live in ``scholium.llm.stages``; this file gives them under the expected name."""

from scholium.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
