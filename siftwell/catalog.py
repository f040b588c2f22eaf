"""All registered queries and their SQL, gathered from the plans."""

from __future__ import annotations

from .plans import alignment, assembly, mentions, ranking, text

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in (ranking, alignment, text, mentions, assembly):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
