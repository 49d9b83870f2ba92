"""Settings of a migration with their defaults. Texts with units are accepted for sizes and durations."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .functions.units import byte_size, duration_ms

#: How batches can be sized. `adaptive` also sets how many are under way, which would mix up a replay's order.
CONTROLLERS = ("fixed", "adaptive_batch", "adaptive")
REPLAY_CONTROLLERS = ("fixed", "adaptive_batch")


@dataclass(frozen=True)
class Settings:
    convergence_threshold: int = 500
    max_convergence_rounds: int = 1000
    permits_per_node: int = 2
    backfill_controller: str = "adaptive_batch"
    replay_controller: str = "adaptive_batch"
    batch_max_bytes: int = 100 << 20
    batch_min_bytes: int = 512 << 10
    batch_max_docs: int = 500
    start_doc_bytes: int = 10 << 10
    aimd_threshold: int = 3
    aimd_ratio: float = 0.20
    aimd_step_bytes: int = 256 << 10
    aimd_cooldown: int = 2
    aimd_revert: float = 0.10
    fixed_batch_docs: int = 500
    backfill_concurrency: int = 1
    page_size: int = 1000
    adaptive_max_concurrency: int = 8
    adaptive_probe: int = 5
    adaptive_gradient: float = 1.5
    overload_base_ms: int = 2000
    overload_max_pause_ms: int = 120_000
    overload_max_failures: int = 50
    liveness_interval_ms: int = 30_000
    liveness_timeout_ms: int = 300_000
    target_ready_ms: int = 4 * 3_600_000
    remove_write_block: bool = False

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Defaults and what is given. Unknown names, wrong controllers and numbers out of bounds are errors."""
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(values) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(cls(), **{k: cls._read(k, known[k].default, v) for k, v in values.items() if v is not None}).checked()

    @staticmethod
    def _read(name: str, default, value):
        if name.endswith("_bytes"):
            return byte_size(value)
        if name.endswith("_ms"):
            return duration_ms(value)
        if isinstance(default, bool):
            return value if isinstance(value, bool) else str(value).lower() == "true"
        return type(default)(value)

    def checked(self) -> Settings:
        if self.backfill_controller not in CONTROLLERS:
            raise ValueError(f"backfill_controller must be one of {', '.join(CONTROLLERS)}")
        if self.replay_controller not in REPLAY_CONTROLLERS:
            raise ValueError(f"replay_controller must be one of {', '.join(REPLAY_CONTROLLERS)}: a replay keeps its order")
        for name in ("batch_max_docs", "fixed_batch_docs", "backfill_concurrency", "page_size", "batch_min_bytes", "adaptive_max_concurrency"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("convergence_threshold", "permits_per_node", "overload_base_ms"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        if self.batch_min_bytes > self.batch_max_bytes:
            raise ValueError("batch_min_bytes is over batch_max_bytes")
        return self
