"""All registered queries over the reference's own operators."""

from __future__ import annotations

from docengine.plans import q_built, q_control, q_hooks, q_json, q_more, q_relational, q_search, q_segments, q_similar, q_sources, q_stored, q_streams, q_text, q_whole_search  # noqa: F401  (they register their queries)
from docengine.plans.registry import ORACLES, QUERIES  # noqa: F401
