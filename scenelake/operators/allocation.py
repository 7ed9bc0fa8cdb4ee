"""How many records each group gives to a sample. These work on counts of groups, which are few; the rows never come here."""

from __future__ import annotations

import math
from collections.abc import Mapping


def even(target: int, sizes: Mapping[str, int]) -> dict[str, int]:
    """Equal shares, capped by size; what is over goes one by one to the group furthest below its share, then with most to spare."""
    ideal = target / max(1, len(sizes))
    got = {g: min(n, math.floor(ideal)) for g, n in sizes.items()}
    left = min(target, sum(sizes.values())) - sum(got.values())
    while left > 0:
        spare = [g for g in got if got[g] < sizes[g]]
        g = max(spare, key=lambda g: (ideal - got[g], sizes[g] - got[g]))
        got[g] += 1
        left -= 1
    return got


def water_fill(target: float, weights: Mapping[str, float], caps: Mapping[str, int]) -> dict[str, float]:
    """min(cap, level * weight) with the level at which the sum is the target, or all caps if they are less."""
    order = sorted((g for g in weights if weights[g] > 0), key=lambda g: caps[g] / weights[g])
    used, rest = 0.0, sum(weights[g] for g in order)
    out = {g: 0.0 for g in weights}
    for i, g in enumerate(order):
        if caps[g] / weights[g] * rest + used > target:
            level = (target - used) / rest
            return out | {h: level * weights[h] for h in order[i:]}
        out[g] = float(caps[g])
        used += caps[g]
        rest -= weights[g]
    return out


def largest_remainder(raw: Mapping[str, float], total: int, caps: Mapping[str, int]) -> dict[str, int]:
    """Whole numbers near ``raw`` that sum to ``total`` where the caps allow it; the largest remainders are rounded up first."""
    got = {g: min(caps[g], math.floor(x + 1e-9)) for g, x in raw.items()}
    left = min(total, sum(caps.values())) - sum(got.values())
    for _ in range(len(got) + 1):
        for g in sorted(got, key=lambda g: (got[g] - raw[g], g)):
            if left > 0 and got[g] < caps[g]:
                got[g] += 1
                left -= 1
        if left <= 0:
            break
    while left > 0:
        g = max((g for g in got if got[g] < caps[g]), key=lambda g: (caps[g] - got[g], g))
        got[g] += 1
        left -= 1
    return got


def percentages(target: int | None, fractions: Mapping[str, float], sizes: Mapping[str, int]) -> dict[str, int]:
    """A fraction of each group, or, with a target, shares of it by weight."""
    if target is None:
        return {g: math.floor(sizes[g] * fractions.get(g, 0.0)) for g in sizes}
    weights = {g: fractions.get(g, 0.0) for g in sizes}
    return largest_remainder(water_fill(target, weights, sizes), min(target, sum(n for g, n in sizes.items() if weights[g] > 0)), {g: n if weights[g] > 0 else 0 for g, n in sizes.items()})


def assign_modes(groups: Mapping[str, int], modes: Mapping[str, int], sizes: Mapping[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """How many of each (mode, group), so that both margins hold, by augmenting paths; an error names what is short."""
    flow = {k: 0 for k in sizes}
    need, have = dict(modes), dict(groups)
    for mode in modes:
        while need[mode] > 0:
            back: dict[tuple[str, str], tuple[str, str] | None] = {("m", mode): None}
            queue, end = [("m", mode)], None
            for kind, name in queue:
                if kind == "m":
                    step = [("g", g) for (m, g), n in sizes.items() if m == name and flow[m, g] < n]
                else:
                    if have[name] > 0:
                        end = (kind, name)
                        break
                    step = [("m", m) for (m, g), n in flow.items() if g == name and n > 0]
                for s in step:
                    if s not in back:
                        back[s] = (kind, name)
                        queue.append(s)
            if end is None:
                raise ValueError(f"no assignment: mode {mode} is short of {need[mode]}")
            have[end[1]] -= 1
            need[mode] -= 1
            while back[end] is not None:
                prev = back[end]
                if end[0] == "g":
                    flow[prev[1], end[1]] += 1
                else:
                    flow[end[1], prev[1]] -= 1
                end = prev
    return flow


def mode_targets(total: int, ratio: Mapping[str, float], available: Mapping[str, int]) -> dict[str, int]:
    """Whole targets for modes in a ratio, capped by what there is."""
    weight = sum(ratio.values())
    return largest_remainder({m: total * r / weight for m, r in ratio.items()}, total, {m: available.get(m, 0) for m in ratio})


def trim(takes: Mapping[str, int], bundles: Mapping[str, int], total: int) -> dict[str, int]:
    """Takes after closure over bundles of records, reduced until ``total`` holds: the group furthest over its take gives first."""
    got = dict(bundles)
    while sum(got.values()) > total:
        g = max((g for g in got if got[g] > 0), key=lambda g: (got[g] - takes.get(g, 0), got[g], g))
        got[g] -= 1
    return got
