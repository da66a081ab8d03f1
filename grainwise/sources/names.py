"""Column names from header rows. Everything here is as small as a schema."""

from __future__ import annotations

import re

from grainwise.errors import ParamsInvalid

# How header rows may be joined, and what makes a column name a period.
JOINS = ("space", "underscore", "bottom_only", "top_only")
MONTHS = ("jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|"
          "january|february|march|april|june|july|august|september|october|november|december")
PERIOD_NAME = (rf"(?i)\s*((?:{MONTHS})[a-z]*[\s\-_/]*\d{{0,4}}"
               r"|(?:19|20)\d{2}(?:[\s\-_/]*(?:q[1-4]|h[12]|\d{1,2}))?"
               r"|q[1-4][\s\-_/]*(?:19|20)?\d{0,4}|fy\s?\d{2,4})\s*")
PIVOT_MIN = 3
PIVOT_SHARE = 0.5


def assemble_names(rows: list[list], join: str = "space", fill: bool = False) -> list[str]:
    """One name per column from one or more header rows.

    `fill` carries the labels of the upper rows rightwards; only a person can say they span.
    Blank names become column_N, repeats get _2, _3 and so on.
    """
    if join not in JOINS:
        raise ParamsInvalid(f"join must be one of {', '.join(JOINS)}")
    if not rows:
        raise ParamsInvalid("a header needs at least one row")
    width = max(map(len, rows))
    grid = [[("" if v is None else str(v).strip()) for v in row] + [""] * (width - len(row)) for row in rows]
    if fill:
        for row in grid[:-1]:
            label = ""
            for i, v in enumerate(row):
                label = v or label
                row[i] = label
    names = []
    for i, parts in enumerate(zip(*grid)):
        if join == "bottom_only":
            name = parts[-1]
        elif join == "top_only":
            name = parts[0]
        else:
            name = (" " if join == "space" else "_").join(p for p in parts if p)
        names.append(name or f"column_{i + 1}")
    return distinct_names(names)


def distinct_names(names: list[str]) -> list[str]:
    """The same names, repeats told apart by a number that no other name holds."""
    taken: set[str] = set()
    uses: dict[str, int] = {}
    out = []
    for name in names:
        number = uses.get(name, 0) + 1
        shown = name if number == 1 else f"{name}_{number}"
        while number > 1 and shown in taken:
            number += 1
            shown = f"{name}_{number}"
        uses[name] = number
        taken.add(shown)
        out.append(shown)
    return out


def target_name(name: str) -> str:
    """A name a query can use bare: lower case words joined by underscores."""
    spelled = name
    for sign, word in (("%", "pct"), ("#", "num"), ("&", "and")):
        spelled = spelled.replace(sign, f" {word} ")
    words = re.findall(r"[0-9A-Za-z]+", spelled)
    joined = "_".join(words).lower()
    if not joined:
        return "unnamed"
    return f"col_{joined}" if joined[0].isdigit() else joined


def target_names(names: list[str]) -> list[str]:
    return distinct_names([target_name(n) for n in names])


def period_columns(names: list[str]) -> list[str]:
    """The columns named like periods, when there are enough of them to be a pivot; else none."""
    found = [n for n in names if re.fullmatch(PERIOD_NAME, str(n))]
    return found if len(found) >= PIVOT_MIN and len(found) >= PIVOT_SHARE * len(names) else []
