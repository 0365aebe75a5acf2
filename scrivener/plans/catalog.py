"""All queries of the core."""

from __future__ import annotations

from . import q_align, q_eval, q_io, q_lm, q_ml, q_more, q_pool, q_records, q_similar, q_small, q_tables, q_text
from .registry import Registry

REGISTRY = Registry()
for part in (q_text, q_tables, q_pool, q_eval, q_similar, q_records, q_align, q_lm, q_more, q_ml, q_io, q_small):
    REGISTRY.merge(part.R)

FLAGSHIP = REGISTRY.queries["e_line_score_by_group"]
