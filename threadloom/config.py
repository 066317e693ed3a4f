"""Settings and their shipped values."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Single-precision widening of 0.99: the percentile is kept as a 32-bit value and used as a double.
ITER_PERCENTILE = 0.9900000095367432


@dataclass(frozen=True)
class AnnotatorConfig:
    min_text_length: int = 20
    parse_links: bool = False
    save_texts: bool = False
    compute_nasty: bool = True
    save_not_news: bool = False
    languages: tuple[str, ...] = ("ru", "en")
    max_words: int = 150


@dataclass(frozen=True)
class ClusteringConfig:
    small_threshold: float = 0.045
    small_size: int = 10
    medium_threshold: float = 0.04
    medium_size: int = 20
    large_threshold: float = 0.035
    large_size: int = 30
    chunk_size: int = 15000
    chunk_overlap: int = 5000
    ban_same_sites: bool = True
    time_penalty: bool = False
    budget: str = "reference"  # or "unbounded": whether rejected merges use up the loop's n - 1 rounds
    weights: dict = field(default_factory=lambda: {"embedding": 1.0})


EN_CLUSTERING = ClusteringConfig()
RU_CLUSTERING = ClusteringConfig(0.12, 10, 0.1, 30, 0.08, 50, 20000, 5000)


@dataclass(frozen=True)
class RankerConfig:
    min_cluster_size: int = 3
    window: int = 28800
    top: int = 1000


@dataclass(frozen=True)
class RatingDefaults:
    pagerank: float = 1.5e-5
    traffic: float = 0.1
    log_floor: float = 0.3
