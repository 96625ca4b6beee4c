"""The bit formulas of ``functions.bits`` as SQL text for DuckDB, for checking one engine against the other."""

from __future__ import annotations

from hexloom.functions.bits import ONES, PENTAGONS

_PENT = ", ".join(map(str, PENTAGONS))
BIG = "CAST(1 AS BIGINT)"


def res(c: str) -> str:
    return f"CAST(({c} >> 52) & 15 AS INTEGER)"


def base(c: str) -> str:
    return f"CAST(({c} >> 45) & 127 AS INTEGER)"


def digit(c: str, r: str) -> str:
    return f"CAST(({c} >> ((15 - ({r})) * 3)) & 7 AS INTEGER)"


def used(c: str) -> str:
    return f"(({c} & {(1 << 45) - 1}) >> ((15 - {res(c)}) * 3))"


def valid(c: str) -> str:
    y = used(c)
    return (
        f"(({c} >> 56) = 8 AND {base(c)} < 122 AND ({c} & ({c} >> 1) & ({c} >> 2) & {ONES}) = ((({BIG} << ((15 - {res(c)}) * 3)) - 1) & {ONES}) "
        f"AND NOT ({base(c)} IN ({_PENT}) AND {y} > 0 AND (length(bin({y})) - 1) % 3 = 0))"
    )


def pentagon(c: str) -> str:
    return f"({base(c)} IN ({_PENT}) AND {used(c)} = 0)"


def parent(c: str, r: int) -> str:
    return f"(({c} & {~(15 << 52)}) | {r << 52} | {(1 << ((15 - r) * 3)) - 1})"


def children(c: str, own: int, r: int) -> str:
    """A list of all descendants at ``r`` of a cell at ``own``, the missing ones of pentagons included."""
    head = f"(({c} & {~(15 << 52)} & {~(((1 << ((15 - own) * 3)) - 1) - ((1 << ((15 - r) * 3)) - 1))}) | {r << 52})"
    parts = " | ".join(f"(((n // {7**t}) % 7) << {(15 - r + t) * 3})" for t in range(r - own))
    return f"[{head} | {parts} FOR n IN range(0, {7 ** (r - own)})]"


def center_child(c: str, own: int, r: int) -> str:
    return f"(({c} & {~(15 << 52)} & {~(((1 << ((15 - own) * 3)) - 1) - ((1 << ((15 - r) * 3)) - 1))}) | {r << 52})"


def hexed(c: str) -> str:
    return f"lower(printf('%x', {c}))"


def edge_origin(e: str) -> str:
    return f"(({e} & {~(127 << 56)}) | {1 << 59})"


def edge(c: str, d: str) -> str:
    return f"(({c} & {~(127 << 56)}) | {2 << 59} | (CAST({d} AS BIGINT) << 56))"
