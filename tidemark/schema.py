"""Schemas of the stored tables, and the engine's configuration."""

from __future__ import annotations

from dataclasses import dataclass

FACTS = "id string, seq long, content string, entity_ids array<string>, effective_at timestamp, created_at timestamp, source string, metadata string, deprecated boolean, replaced_by string"
ENTITIES = "id string, name string, metadata string, seq long"
RELATIONS = "id string, seq long, source_id string, target_id string, type string, metadata string"
SUPERSESSION = "old_id string, new_id string, at_seq long, score double, manual boolean"
TOMBSTONES = "id string, seq long"
# What is derived from a fact's content when it is written, so that no search and no write reads contents again.
POSTINGS = "term string, id string, seq long, tf long, dl long"
KEYS = "key string, id string, seq long"
SKETCHES = "id string, seq long, tokens array<string>, entity_ids array<string>, effective_at timestamp, deprecated boolean, v array<float>, signature array<long>"


@dataclass(frozen=True)
class EngineConfig:
    conflict_threshold: float = 0.55
    related_jaccard: float = 0.25
    auto_resolve: bool = True
    rrf_k: int = 60
    freshness_weight: float = 0.0
    freshness_halflife_days: float = 30.0
    current_state_demote: bool = False
    stale_penalty: float = 0.02
    dim: int = 512


#: Current-state preset: outdated facts are demoted instead of dropped.
CURRENT_STATE = EngineConfig(current_state_demote=True, stale_penalty=0.02)
#: The same with a model embedder.
CURRENT_STATE_MODEL = EngineConfig(conflict_threshold=0.45, freshness_weight=1.0, current_state_demote=True, stale_penalty=0.02)
