"""Settings of an analysis, with the defaults that users know."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Options:
    """sigma: minimum support of a result; epsilon: support from which patterns are kept (at most sigma); shares of events.

    ``batch_seconds`` is the length of a batch, ``thresholds_csv`` a file of thresholds instead of the default ones.
    """

    sigma: float = 0.05
    epsilon: float = 0.04
    confidence: float = 0.2
    max_len: int | None = None
    batch_seconds: int = 900
    thresholds_csv: str | None = None

    def __post_init__(self):
        if not 0 <= self.epsilon <= self.sigma <= 1 or not 0 <= self.confidence <= 1:
            raise ValueError("0 <= epsilon <= sigma <= 1 and 0 <= confidence <= 1 must hold")

    def changed(self, **values) -> Options:
        return replace(self, **values)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        """Stored settings; what is missing has its default, unknown keys are ignored."""
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in values.items() if k in known})


def epsilon_of(sigma: float, margin: float) -> float:
    """The support to keep patterns from, for an error margin given as a share of sigma."""
    return sigma * (1 - margin)


def margin_of(sigma: float, epsilon: float) -> float:
    """The error margin that an epsilon stands for."""
    return 1 - epsilon / sigma if sigma else 0.0
