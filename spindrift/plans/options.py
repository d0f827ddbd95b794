"""Parameters of the analysis, checked before any work."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Fixed: what counts as true in the environment.
TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Options:
    min_score: float = 0.5
    window: int = 1200
    overlap: int = 200
    max_characters: int | None = 50_000  # None: texts stay whole
    max_batch: int = 50
    max_word_gap: int = 1
    salt: str = ""
    profile: str = "server"

    def __post_init__(self):
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must be between 0 and 1")
        if self.window <= 0 or not 0 <= self.overlap < self.window:
            raise ValueError("the window must be positive and the overlap smaller than it")
        if (self.max_characters or 0) < 0 or self.max_batch < 1:
            raise ValueError("limits must be positive")
        if self.profile not in ("server", "browser"):
            raise ValueError(f"unknown profile: {self.profile}")

    @classmethod
    def from_env(cls, env=os.environ) -> Options:
        """From the NER_ variables, where they are set."""
        names = {"min_score": "MIN_SCORE", "window": "WINDOW_CHARS", "overlap": "OVERLAP_CHARS", "max_characters": "MAX_CHARACTERS",
                 "max_batch": "MAX_BATCH", "salt": "PSEUDONYM_SALT"}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](env[f"NER_{v}"]) for k, v in names.items() if f"NER_{v}" in env})

    @classmethod
    def browser(cls, **changes) -> Options:
        """The browser profile's limits: 20,000 characters, one window."""
        return cls(**{"window": 20_000, "overlap": 0, "max_characters": 20_000, "max_batch": 200, "profile": "browser"} | changes)


def check_sensitivity(least: int) -> int:
    if not 0 <= least <= 5:
        raise ValueError("min_sensitivity must be between 0 and 5")
    return least


def flag(value: str) -> bool:
    return value.strip().lower() in TRUE


#: Fixed: the other variables of a deployment, with their defaults. The first group chooses the classifier, the second is the
#: host's and has no use in a plan; it is read so that a deployment can be listed as a whole.
CLASSIFIER = {"BACKEND": "huggingface", "MODEL_ID": "", "MODEL_REVISION": "", "AGGREGATION": "simple"}
HOST = {"CACHE_SIZE": "128", "CORS_ORIGINS": "*", "WARMUP": "false", "FRONTEND_DIR": "static"}


def deployment(env=os.environ) -> dict[str, object]:
    """All settings of the environment by name: those of Options, the classifier's and the host's."""
    own = Options.from_env(env)
    rest = {k: env.get(f"NER_{k}", v) for k, v in (CLASSIFIER | HOST).items()}
    out = {k.lower(): v for k, v in rest.items()} | {f.name: getattr(own, f.name) for f in fields(own)}
    return out | {
        "backend": rest["BACKEND"].strip().lower(), "cache_size": int(rest["CACHE_SIZE"]), "warmup": flag(rest["WARMUP"]), "cors_origins": origins(rest["CORS_ORIGINS"]),
    }


def origins(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]
