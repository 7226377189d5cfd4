"""Pieces of SQL for the oracles."""

from __future__ import annotations


def jr(x: str, n: int = 0) -> str:
    """Half toward positive infinity."""
    f = 10**n
    return f"(floor(({x}) * {f}e0 + 0.5e0) / {f}e0)"


def hr(x: str) -> str:
    return f"(floor(({x}) * 2e0 + 0.5e0) / 2e0)"


def clamp(x: str, low: float, high: float) -> str:
    return f"least({high}e0, greatest({low}e0, {x}))"


def corner_score(w: str) -> str:
    return clamp(hr(f"10e0 - {w} * 55e0"), 1, 10)


def edge_score(w: str, n: str) -> str:
    return clamp(hr(f"10e0 - {w} * 45e0 - {n} * 0.5e0"), 1, 10)


def surface_score(d: str, p: str, g: str) -> str:
    return clamp(hr(f"10e0 - {d} * 40e0 - {p} * 0.75e0 - (1e0 - {g}) * 2e0"), 1, 10)


def centering_score(worst: str) -> str:
    d = clamp(f"{worst} - 50e0", 0, 50)
    return hr(f"(CASE WHEN {d} <= 5 THEN 10e0 WHEN {d} <= 10 THEN 10e0 - ({d} - 5e0) * 0.2e0 WHEN {d} <= 15 THEN 9e0 - ({d} - 10e0) * 0.2e0 WHEN {d} <= 20 THEN 8e0 - ({d} - 15e0) * 0.2e0 WHEN {d} <= 30 THEN 7e0 - ({d} - 20e0) * 0.2e0 WHEN {d} <= 40 THEN 5e0 - ({d} - 30e0) * 0.2e0 ELSE 2e0 END)")


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def collector_number(x: str) -> str:
    token = f"regexp_replace(split_part(trim({x}), '/', 1), '[^A-Za-z0-9]', '', 'g')"
    return f"nullif(lower(CASE WHEN regexp_matches({token}, '^[A-Za-z]') THEN {token} ELSE regexp_replace({token}, '^0+([0-9])', '\\1') END), '')"


def printed_total(x: str) -> str:
    return f"TRY_CAST(regexp_extract(coalesce({x}, ''), '/\\s*[A-Za-z]*0*([0-9]{{1,3}})', 1) AS INT)"


def similarity(a: str, b: str) -> str:
    x, y = key(a), key(b)
    return f"(CASE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0e0 WHEN {x} = {y} THEN 1e0 ELSE 1e0 - CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y})) END)"


def issue(value: str, levels: list[tuple[float, str]]) -> str:
    return "(CASE " + " ".join(f"WHEN {value} > {low}e0 THEN '{name}'" for low, name in levels) + " END)"
