"""The table of fits to 500 mm (S4, T4), made from base values by the rules of the standard; other tables are read from files, see tolerance.read_table()."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

# ISO 286-1, sizes up to 500 mm. Grades and deviations in micrometres by the range that ends at each size in mm
RANGES = "3 6 10 18 30 50 80 120 180 250 315 400 500"
GRADES = {
    "IT5": "4 5 6 8 9 11 13 15 18 20 23 25 27",
    "IT6": "6 8 9 11 13 16 19 22 25 29 32 36 40",
    "IT7": "10 12 15 18 21 25 30 35 40 46 52 57 63",
    "IT8": "14 18 22 27 33 39 46 54 63 72 81 89 97",
    "IT9": "25 30 36 43 52 62 74 87 100 115 130 140 155",
    "IT10": "40 48 58 70 84 100 120 140 160 185 210 230 250",
}
SHAFT_UPPER = {
    "d": "20 30 40 50 65 80 100 120 145 170 190 210 230",
    "e": "14 20 25 32 40 50 60 72 85 100 110 125 135",
    "f": "6 10 13 16 20 25 30 36 43 50 56 62 68",
    "g": "2 4 5 6 7 9 10 12 14 15 17 18 20",
}
SHAFT_LOWER = {
    "k": "0 1 1 1 2 2 2 3 3 4 4 4 5",
    "m": "2 4 6 7 8 9 11 13 15 17 20 21 23",
    "n": "4 8 10 12 15 17 20 23 27 31 34 37 40",
    "p": "6 12 15 18 22 26 32 37 43 50 56 62 68",
    "j5": "-2 -2 -2 -3 -4 -5 -7 -9 -11 -13 -16 -18 -20",
    "j6": "-2 -2 -2 -3 -4 -5 -7 -9 -11 -13 -16 -18 -20",
    "j7": "-4 -4 -5 -6 -8 -10 -12 -15 -18 -21 -26 -28 -32",
}
HOLE_UPPER = {
    "J6": "2 5 5 6 8 10 13 16 18 22 25 29 33",
    "J7": "4 6 8 10 12 14 18 22 26 30 36 39 43",
    "J8": "6 10 12 15 20 24 28 34 41 47 55 60 66",
}
FINE_RANGES = "3 6 10 18 24 30 40 50 65 80 100 120 140 160 180 200 225 250 280 315 355 400 450 500"
FINE_UPPER = {"c": "60 70 80 95 110 110 120 130 140 150 170 180 200 210 230 240 260 280 300 330 360 400 440 480"}
FINE_LOWER = {
    "r": "10 15 19 23 28 28 34 34 41 43 51 54 63 65 68 77 80 84 94 98 108 114 126 132",
    "s": "14 19 23 28 35 35 43 43 53 59 71 79 92 100 108 122 130 140 158 170 190 208 232 252",
    "t": "- - - - - 41 48 54 66 75 91 104 122 134 146 166 180 196 218 240 268 294 330 360",
    "u": "18 23 28 33 41 48 60 70 87 102 124 144 170 190 210 236 258 284 315 350 390 435 490 540",
}


def _mm(micrometres: Decimal | None) -> str:
    return "-" if micrometres is None else f"{micrometres / 1000:f}"


def _values(text: str) -> list[Decimal | None]:
    return [None if v == "-" else Decimal(v) for v in text.split()]


def _part(ends: str, columns: dict[str, list[Decimal | None]], **part: Any) -> dict[str, Any]:
    sizes = ends.split()
    rows = [{**({"min_exclusive": sizes[i - 1]} if i else {}), "max_inclusive": s, "values": [_mm(v[i]) for v in columns.values()]} for i, s in enumerate(sizes)]
    return {**part, "value_unit": "mm", "columns": list(columns), "rows": rows}


def _negative(columns: dict[str, list[Decimal | None]]) -> dict[str, list[Decimal | None]]:
    return {k: [None if v is None else -v for v in vs] for k, vs in columns.items()}


def _merged(part: dict[str, Any], fine: dict[str, Any]) -> dict[str, Any]:
    """Two parts as one of the finer ranges; a fine range lies in one coarse one."""
    ends = [Decimal(r["max_inclusive"]) for r in part["rows"]]
    rows = []
    for r in fine["rows"]:
        of = next(i for i, e in enumerate(ends) if Decimal(r["max_inclusive"]) <= e)
        rows.append({**r, "values": [*part["rows"][of]["values"], *r["values"]]})
    return {**part, "columns": [*part["columns"], *fine["columns"]], "rows": rows}


def table() -> dict[str, Any]:
    """The parts in the form of a table file.

    From grade 6 on each fifth grade is ten times as wide; holes mirror shafts; delta is what a grade is wider than the one before, from 3 mm on.
    Not in it: grades under 5 and their deltas, the letters a, b, cd, ef, fg, v to zc, and sizes over 500 mm.
    """
    grades: dict[str, list[Decimal | None]] = {k: _values(v) for k, v in GRADES.items()}
    for n in range(11, 19):
        grades[f"IT{n}"] = [v * 10 for v in grades[f"IT{n - 5}"]]
    upper, lower = _negative({k: _values(v) for k, v in SHAFT_UPPER.items()}), {k: _values(v) for k, v in SHAFT_LOWER.items()}
    fine_upper, fine_lower = _negative({k: _values(v) for k, v in FINE_UPPER.items()}), {k: _values(v) for k, v in FINE_LOWER.items()}
    zero = [Decimal(0)] * len(RANGES.split())
    upper["h"], lower["k_other"] = zero, zero
    mirrored = _negative({k.upper(): lower[k] for k in ("k", "m", "n", "p")})
    above = {"K_above_IT8": [Decimal(0), *[None] * (len(zero) - 1)], "M_above_IT8": mirrored["M"], "N_above_IT8": [Decimal(-4), *zero[1:]]}
    delta = {f"IT{n}": [Decimal(0), *[a - b for a, b in zip(grades[f"IT{n}"][1:], grades[f"IT{n - 1}"][1:], strict=True)]] for n in (6, 7, 8)}
    shaft, hole, deviation = {"feature": "shaft"}, {"feature": "hole"}, "fundamental_deviation"
    parts = [
        _part(RANGES, grades, id="standard_tolerance", kind="standard_tolerance"),
        _merged(_part(RANGES, upper, id="shaft_upper", kind=deviation, deviation="upper", **shaft), _part(FINE_RANGES, fine_upper)),
        _merged(_part(RANGES, lower, id="shaft_lower", kind=deviation, deviation="lower", **shaft), _part(FINE_RANGES, fine_lower)),
        _merged(_part(RANGES, _negative({k.upper(): v for k, v in upper.items()}), id="hole_lower", kind=deviation, deviation="lower", **hole), _part(FINE_RANGES, _negative({k.upper(): v for k, v in fine_upper.items()}))),
        _merged(_part(RANGES, {k: _values(v) for k, v in HOLE_UPPER.items()} | mirrored | above, id="hole_upper", kind=deviation, deviation="upper", **hole), _part(FINE_RANGES, _negative({k.upper(): v for k, v in fine_lower.items()}))),
        _part(RANGES, delta, id="delta", kind="delta"),
        {"id": "special_cases", "kind": "override", "value_unit": "mm", "columns": ["M6"], "rows": [{"min_exclusive": "250", "max_inclusive": "315", "values": ["-0.009"]}]},
    ]
    # up to 1 mm grades from 14 on and N above grade 8 are not used
    for part, columns in ((parts[0], [f"IT{n}" for n in range(14, 19)]), (parts[4], ["N_above_IT8"])):
        first = part["rows"][0]
        small = ["-" if c in columns else v for c, v in zip(part["columns"], first["values"], strict=True)]
        part["rows"] = [{"max_inclusive": "1", "values": small}, {**first, "min_exclusive": "1"}, *part["rows"][1:]]
    return {"table": {"id": "iso-286", "version": 2, "kind": "fit", "status": "verified"}, "part": parts}
