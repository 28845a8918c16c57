"""Settings of the retrieval engine and its fixed word list."""

from __future__ import annotations

import os
from dataclasses import dataclass

# The English stopwords of the keyword leg.
STOPWORDS = (
    "a an and are as at be by do does for from how i in into is it its my of on or that the their to was what when where which who why will with you your me we our"
).split()

MODES = ("keyword_only", "vector_only", "hybrid", "hybrid_rerank")
#: Model prices in USD for a million tokens.
PRICES = {"input": 3.0, "output": 15.0, "cache_write": 3.75, "cache_read": 0.30}


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of retrieval; from_env reads the variables of the same names."""

    hybrid_fusion: str = "adaptive"
    hybrid_alpha: float = 0.5
    hybrid_alpha_lexical: float = 0.3
    hybrid_alpha_semantic: float = 1.0
    hybrid_adaptive_signal: str = "regex"
    hybrid_lex_df_max: int = 5
    rerank_candidates: int = 30
    rerank_pool: str = "hybrid"
    rerank_include_path: bool = True
    retrieval_min_rerank_score: float = 0.1
    rrf_k: int = 60
    pool_depth: int = 30

    @classmethod
    def from_env(cls) -> RetrievalConfig:
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            if (raw := os.environ.get(name.upper())) is not None:
                kind = type(field.default)
                found[name] = raw not in ("0", "false", "") if kind is bool else kind(raw)
        return cls(**found)

    def stamp(self) -> dict[str, str]:
        """The configuration as text, for reports and table properties."""
        return {k: str(getattr(self, k)) for k in self.__dataclass_fields__}
