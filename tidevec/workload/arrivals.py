"""Arrival times with random rates, reproducible by seed.

A gap is exponential, at the base rate times a multiplier drawn anew for each gap. The multiplier and
the gap come from NumPy's legacy generator, in this order, so that equal seeds give equal times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

BASE_RATE = 10.0


@dataclass(frozen=True)
class Multiplier:
    """A draw of the generator by ``method`` and its parameters with their defaults, scaled, and ``least`` at least."""

    method: str
    defaults: tuple[tuple[str, float], ...]
    scale: float = 1.0
    least: float | None = None

    def draw(self, state: np.random.RandomState, given: dict) -> float:
        x = self.scale * getattr(state, self.method)(*(given.get(name, default) for name, default in self.defaults))
        return x if self.least is None else max(self.least, x)


# The distributions, their parameters' names and defaults.
MULTIPLIERS = {
    "lognormal": Multiplier("lognormal", (("mu", 0), ("sigma", 1))),
    "normal": Multiplier("normal", (("mu", 0.0), ("sigma", 1.0)), least=0.1),
    "poisson": Multiplier("poisson", (("lam", 5),), least=0.1),
    "uniform": Multiplier("uniform", (("rate_min", 0.5), ("rate_max", 2.0))),
    "zipf": Multiplier("zipf", (("a", 1.1),), scale=0.5),
}


@dataclass(frozen=True)
class Stream:
    """``n`` operations whose gaps follow one distribution."""

    n: int
    distribution: str
    params: dict


class Arrivals:
    def __init__(self, seed: int, base_rate: float = BASE_RATE) -> None:
        self.state, self.base_rate = np.random.RandomState(seed), base_rate

    def gap(self, stream: Stream) -> float:
        if stream.distribution not in MULTIPLIERS:
            raise ValueError(f"unknown distribution: {stream.distribution!r}")
        return self.state.exponential(1.0 / (self.base_rate * MULTIPLIERS[stream.distribution].draw(self.state, stream.params)))

    def single(self, stream: Stream) -> list[float]:
        return list(accumulate(self.gap(stream) for _ in range(stream.n)))

    def merged(self, streams: list[Stream]) -> Iterator[tuple[int, float]]:
        """(stream, time): each step, every stream with operations left draws its next time anew; the earliest goes, on ties the first stream's."""
        clock, left = [0.0] * len(streams), [s.n for s in streams]
        for _ in range(sum(left)):
            at, which = min((clock[i] + self.gap(s), i) for i, s in enumerate(streams) if left[i])
            clock[which], left[which] = at, left[which] - 1
            yield which, at
