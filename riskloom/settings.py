"""One frozen settings object, read from the environment once per job."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Thresholds, topic names and windows that existing deployments rely on.
_ENVIRONMENT = {
    "model_version": "MODEL_VERSION",
    "review_threshold": "REVIEW_THRESHOLD",
    "block_threshold": "BLOCK_THRESHOLD",
    "kafka_bootstrap_servers": "KAFKA_BOOTSTRAP_SERVERS",
    "kafka_transactions_topic": "KAFKA_TRANSACTIONS_TOPIC",
    "kafka_decisions_topic": "KAFKA_DECISIONS_TOPIC",
    "kafka_consumer_group": "KAFKA_CONSUMER_GROUP",
    "velocity_ttl_seconds": "VELOCITY_TTL_SECONDS",
    "drift_window_size": "DRIFT_WINDOW_SIZE",
    "drift_threshold": "DRIFT_THRESHOLD",
    "min_pr_auc_improvement": "MIN_PR_AUC_IMPROVEMENT",
    "training_window_steps": "TRAINING_WINDOW_STEPS",
}


@dataclass(frozen=True)
class Settings:
    model_version: str = "v1"
    review_threshold: float = 0.3
    block_threshold: float = 0.7
    kafka_bootstrap_servers: str = "localhost:9092"
    kafka_transactions_topic: str = "transactions"
    kafka_decisions_topic: str = "fraud-decisions"
    kafka_consumer_group: str = "fraud-scoring-service"
    velocity_ttl_seconds: int = 7200
    drift_window_size: int = 50000
    drift_threshold: float = 0.3
    min_pr_auc_improvement: float = 0.005
    training_window_steps: int = 500

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        defaults = cls()
        given = {}
        for field in fields(cls):
            raw = env.get(_ENVIRONMENT[field.name])
            if raw is not None:
                given[field.name] = type(getattr(defaults, field.name))(raw)
        return cls(**given)

    @property
    def velocity_ttl_steps(self) -> int:
        """A step is one hour, so the time-to-live in whole steps (at least one)."""
        return max(1, self.velocity_ttl_seconds // 3600)
