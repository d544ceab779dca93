"""All parameters of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

PHASES = ("fulltext", "sumo", "entity_pivot", "cross_doc_edge", "structural", "vector", "answers_same", "cluster_summary")


@dataclass(frozen=True)
class EngineConfig:
    """Defaults that results depend on."""

    limit: int = 20
    structural_depth: int = 2
    cross_doc_limit: int = 5
    expand_depth: int = 1
    vector_limit: int = 10
    ontology_depth: int = 3
    seed_rows: int = 5
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    weights: dict = field(
        default_factory=lambda: {
            "fulltext": 1.0, "sumo": 0.4, "entity_pivot": 0.6, "cross_doc_edge": 0.4,
            "structural": 0.3, "vector": 0.5, "answers_same": 0.5, "cluster_summary": 0.6,
        }
    )
    multipliers: dict = field(
        default_factory=lambda: {
            "factoid": {"fulltext": 1.0, "sumo": 0.8, "entity_pivot": 0.7, "cross_doc_edge": 0.5, "structural": 0.6, "vector": 0.8, "answers_same": 0.4, "cluster_summary": 0.2},
            "synthesis": {"fulltext": 0.6, "sumo": 1.0, "entity_pivot": 0.8, "cross_doc_edge": 0.8, "structural": 0.4, "vector": 1.0, "answers_same": 0.8, "cluster_summary": 1.2},
            "exploratory": {"fulltext": 0.7, "sumo": 0.9, "entity_pivot": 1.2, "cross_doc_edge": 1.2, "structural": 0.5, "vector": 0.9, "answers_same": 1.0, "cluster_summary": 0.8},
        }
    )
    decay_rates: dict = field(default_factory=lambda: {"EVERGREEN": 1e-6, "SCHOLARLY": 1e-4, "CURRENT": 1e-2, "EPHEMERAL": 1e-1})
    temporal_weight: float = 0.2
    gate_floor: float = 5.0
    age_lambda: float = 0.000274
    principal_percentile: float = 0.75
    principal_limit: int = 5
    integrity_min: float = 0.6
    explorer_stop: float = 0.15
    similarity_threshold: float = 0.1
    evergreen_indegree: int = 5
    aa_threshold: float = 0.3
    aa_least_common: int = 2
    isolation_degree: int = 2
    fragment_chars: int = 120
    tiny_chars: int = 60
    virtual_page: int = 3000
    chunk_chars: int = 12000
    chunk_least: int = 500
    reasoning_iterations: int = 2
    reasoning_delta: float = 0.05

    def phase_weights(self, mode: str = "factoid", adaptive: bool = True) -> dict[str, float]:
        """Weight of each phase for a query mode."""
        more = self.multipliers[mode] if adaptive else dict.fromkeys(PHASES, 1.0)
        return {phase: self.weights[phase] * more[phase] for phase in PHASES}


DEFAULT = EngineConfig()
