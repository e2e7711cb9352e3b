"""The flow that routes a mix, at the bound that its module states and against linear search on small ones."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from skein.llm import mixing


def made(seed: int, n: int, sources: int, most: int) -> tuple[list, dict]:
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(sources)]
    seen = set()
    while len(seen) < n:
        seen.add(tuple(sorted(rng.sample(names, 3))))
    patterns = [(k, rng.randrange(1, most)) for k in sorted(seen)]
    total, weights = sum(s for _, s in patterns), {m: i % 3 + 1 for i, m in enumerate(names)}
    return patterns, {m: total * w // sum(weights.values()) for m, w in weights.items()}


def test_as_many_patterns_as_the_bound_allows():
    patterns, quotas = made(1, mixing.MAX_PATTERNS, 120, 100_000)
    began = time.perf_counter()
    flow = mixing.route(patterns, quotas)
    assert time.perf_counter() - began < 60
    assert sum(flow) == sum(quotas.values())
    assert all(0 <= f <= 3 * s for f, (_, s) in zip(flow, patterns, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_routes_are_cheapest(seed):
    """All flows of a few tokens are tried; the routed one meets as much of the quotas for as little."""
    rng = random.Random(seed)
    patterns = [(k, rng.randrange(1, 3)) for k in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)]
    quotas = {m: rng.randrange(0, 5) for m in "abc"}

    def price(flow) -> int:
        return sum(sum(c * min(max(f - i * s, 0), s) for i, c in enumerate(mixing.REPEAT_COST)) for f, (_, s) in zip(flow, patterns, strict=True))

    def fits(flow) -> bool:  # whether the sources can take what the patterns give
        left = [(f, k) for f, (k, _) in zip(flow, patterns, strict=True)]
        return all(sum(f for f, k in left if set(k) <= set(some)) <= sum(quotas[m] for m in some) for n in range(1, 4) for some in itertools.combinations("abc", n))

    every = [f for f in itertools.product(*(range(3 * s + 1) for _, s in patterns)) if fits(f)]
    most = max(map(sum, every))
    flow = mixing.route(patterns, quotas)
    assert fits(flow) and sum(flow) == most and price(flow) == min(price(f) for f in every if sum(f) == most)
