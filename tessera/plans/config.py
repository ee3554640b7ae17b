"""Configuration: dataclasses with the default parameters, read from YAML with ${NAME:-default}."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_type_hints


@dataclass
class Source:
    """One collected source; attention_weight in [0, 1]."""

    name: str
    kind: str
    enabled: bool = False
    side: str = "unknown"
    archive_url: str | None = None
    feed_url: str | None = None
    sitemap_url: str | None = None
    listing_url: str | None = None
    title_include: str | None = None
    url_include: str | list[str] | None = None
    max_pages: int = 1
    limit: int = 3
    fetch_article: bool = True
    min_text_chars: int = 300
    attention_weight: float = 0.7
    attention_note: str | None = None
    note: str | None = None

    def __post_init__(self):
        if not 0 <= self.attention_weight <= 1:
            raise ValueError("attention_weight must lie in [0, 1]")


#: Types of entities, extraction providers and graph backends.
ENTITY_TYPES = ("person", "organization", "company", "place", "event", "other")
PROVIDERS = ("auto", "deepseek", "dev")
BACKENDS = ("sqlite", "neo4j")


@dataclass
class KnownEntity:
    """A catalogue entity with its aliases."""

    name: str
    entity_type: str = "other"
    aliases: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.entity_type not in ENTITY_TYPES:
            raise ValueError(f"{self.entity_type} is no entity type")


@dataclass
class Resolver:
    """Extra alias groups and the threshold of fuzzy matching."""

    aliases: dict[str, list[str]] = field(default_factory=dict)
    similarity_threshold: float = 0.92


@dataclass
class Scoring:
    """Parameters of the sceptical controls. The defaults."""

    enabled: bool = True
    null_model_samples: int = 100
    null_model_seed: int = 20260608
    null_model_alpha: float = 0.1
    temporal_window_days: int = 7
    independence_threshold: float = 0.45
    improbability_threshold: float = 0.55
    specificity_threshold: float = 0.45
    temporal_threshold: float = 0.4
    min_final_score: float = 0.5


#: Words that mark a denial or correction.
DENIAL_KEYWORDS = (
    "not true", "is false", "false", "denied", "rejected", "clarified", "no es cierto", "es falso", "falso", "mentira", "desment", "rechaz", "aclar",
    "no tenemos informacion", "no tenemos información", "no hay informacion", "no hay información",
)


@dataclass
class Signals:
    """Parameters of the reading signals. The defaults."""

    enabled: bool = True
    small_note_top_n: int = 10
    morning_top_n: int = 10
    novelty_window_days: int = 21
    low_attention_threshold: float = 0.35
    structural_novelty_threshold: float = 0.25
    small_note_min_score: float = 0.45
    morning_lookback_days: int = 14
    min_non_official_mentions: int = 1
    official_side: str = "official_government"
    denial_keywords: list[str] = field(default_factory=lambda: list(DENIAL_KEYWORDS))


@dataclass
class Project:
    """Folders and the transport's limits."""

    user_agent: str = ""
    request_delay_seconds: float = 1.0
    allow_robots_unavailable: bool = False
    cache_dir: str = "data/cache"
    database_path: str = "data/state"
    output_dir: str = "data/output"

    def __post_init__(self):
        self.request_delay_seconds = max(1.0, float(self.request_delay_seconds))


@dataclass
class Extraction:
    """The extraction provider and what identifies its policy. auto is the hosted one where its key is in the environment."""

    provider: str = "dev"
    base_url: str = ""
    model: str = ""
    temperature: float = 0.1
    max_output_tokens: int = 5000
    max_chars_per_document: int = 18000
    thinking: str = "disabled"
    user_id: str = ""
    cache_extractions: bool = True

    def __post_init__(self):
        if self.provider not in PROVIDERS:
            raise ValueError(f"{self.provider} is no extraction provider")


@dataclass
class Graph:
    """Where the graph goes: snapshots, or a property-graph export whose password must be given."""

    backend: str = "sqlite"
    neo4j: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"{self.backend} is no graph backend")
        if self.backend == "neo4j" and not self.neo4j.get("password"):
            raise ValueError("the property-graph backend needs a password")


@dataclass
class AppConfig:
    """The whole configuration."""

    project: Project = field(default_factory=Project)
    llm: Extraction = field(default_factory=Extraction)
    resolver: Resolver = field(default_factory=Resolver)
    graph: Graph = field(default_factory=Graph)
    scoring: Scoring = field(default_factory=Scoring)
    signals: Signals = field(default_factory=Signals)
    known_entities: list[KnownEntity] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)


_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand_env(value: Any) -> Any:
    """Replace ${NAME:-default} everywhere; an empty variable counts as unset."""
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v) for v in value]
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1]) or (m[2] or ""), value)
    return value


def _build(kind: type, value: Any) -> Any:
    if is_dataclass(kind) and isinstance(value, dict):
        hints = get_type_hints(kind)
        known = {f.name for f in fields(kind)}
        if unknown := set(value) - known:
            raise ValueError(f"unknown settings of {kind.__name__}: {sorted(unknown)}")
        return kind(**{k: _build(hints[k], v) for k, v in value.items()})
    if isinstance(value, list) and get_args(kind) and is_dataclass(get_args(kind)[0]):
        return [_build(get_args(kind)[0], v) for v in value]
    return value


def load_config(path: str) -> AppConfig:
    """Read and check a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return _build(AppConfig, expand_env(yaml.safe_load(f) or {}))
