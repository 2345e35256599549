"""Settings of the facade."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanerConfig:
    """missing_value_tokens extend the defaults of token normalisation; thresholds are in percent."""

    missing_value_tokens: tuple[str, ...] = field(default=())
    missing_threshold: float | None = None
    quantile_accuracy: int | None = None

    def __post_init__(self) -> None:
        if self.missing_threshold is not None and not 0 <= self.missing_threshold <= 100:
            raise ValueError("missing_threshold must be between 0 and 100")
        if self.quantile_accuracy is not None and self.quantile_accuracy <= 0:
            raise ValueError("quantile_accuracy must be positive")
