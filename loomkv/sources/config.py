"""Settings: an explicit value, else the environment's LOOMKV_<NAME>, else the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


def split_list(text: str) -> tuple[str, ...]:
    return tuple(x for x in map(str.strip, text.split(",")) if x)


def routable(address: str) -> bool:
    """Whether others can reach it: a host that is named and not unspecified."""
    host = address.rpartition(":")[0].strip("[]")
    return host not in ("", "0.0.0.0", "::")


@dataclass(frozen=True)
class Config:
    self_id: str = "n0"
    seeds: tuple[str, ...] = ()
    max_key_bytes: int = 1024
    max_value_bytes: int = 1 << 20
    max_entries: int = 0
    policy: str = "none"
    shards: int = 64
    vnodes: int = 100
    n: int = 3
    r: int = 2
    w: int = 2
    fanout: int = 3
    gossip_interval_ms: int = 1000
    fail_timeout_ms: int = 5000
    merkle_leaves: int = 1024
    tombstone_grace_s: int = 3600
    advertise: str = "127.0.0.1:7000"
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.r <= self.n or not 1 <= self.w <= self.n:
            raise ValueError("r and w must lie between 1 and n")
        if self.policy not in ("none", "lru", "lfu", "tinylfu"):
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.policy != "none" and self.max_entries <= 0:
            raise ValueError("a policy needs max_entries")
        if min(self.shards, self.vnodes, self.merkle_leaves, self.fanout, self.gossip_interval_ms, self.fail_timeout_ms) < 1:
            raise ValueError("counts and intervals must be positive")
        if min(self.max_key_bytes, self.max_value_bytes, self.max_entries, self.tombstone_grace_s) < 0:
            raise ValueError("limits may not be negative")
        if not routable(self.advertise):
            raise ValueError("the advertised address must name a host")

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **given) -> Config:
        out = {}
        for f in fields(cls):
            raw = env.get(f"LOOMKV_{f.name.upper()}")
            if f.name in given:
                out[f.name] = given[f.name]
            elif raw is not None and f.name != "extra":
                kind = type(f.default)
                out[f.name] = split_list(raw) if f.name == "seeds" else kind(raw)
        return cls(**out)
