"""Range dictionaries as files: RNG, ENV and RRNG, and isotope tables (XML).

All are small; they are parsed on the driver into a :class:`RangeTable`.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from pointloom.functions.names import compose
from pointloom.operators.ranging import Ion, Range, RangeTable

MOST_BYTES = 20 << 20


class FormatError(ValueError):
    pass


def _numbers(words: list[str]) -> list[float]:
    try:
        return [float(w) for w in words]
    except ValueError as e:
        raise FormatError(f"numbers expected: {' '.join(words)}") from e


def parse_rng(text: str) -> RangeTable:
    """Counts, names with colours, a dashed header, then rows of bounds and multiplicities."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        n_ions, n_ranges = map(int, lines[0].split()[:2])
    except (IndexError, ValueError) as e:
        raise FormatError("two counts expected") from e
    if n_ions < 1 or n_ranges < 1 or len(lines) < 2 + 2 * n_ions + n_ranges:
        raise FormatError("the file is too short")
    ions = []
    for k in range(n_ions):
        words = lines[2 + 2 * k].split()
        ions.append(Ion(words[0], lines[1 + 2 * k].strip(), tuple(_numbers(words[1:4]))))
    if not lines[1 + 2 * n_ions].lstrip().startswith("-"):
        raise FormatError("a dashed header expected")
    rows = []
    for line in lines[2 + 2 * n_ions : 2 + 2 * n_ions + n_ranges]:
        words = line.split()
        if len(words) == n_ions + 3:
            words = words[1:]
        if len(words) != n_ions + 2:
            raise FormatError(f"{n_ions + 2} fields expected: {line}")
        low, high, *units = _numbers(words)
        if not low < high:
            raise FormatError(f"empty range: {line}")
        rows.append((low, high, [int(u) for u in units]))
    if not any(any(u) for _, _, u in rows):
        raise FormatError("no range has an ion")
    ranges = []
    for low, high, units in rows:
        if sum(units) == 0:
            continue
        if sum(units) == 1:
            ranges.append(Range(low, high, units.index(1)))
            continue
        name = compose([(ions[k].short, u) for k, u in enumerate(units) if u])
        known = next((k for k, i in enumerate(ions) if i.short == name), None)
        if known is None:
            known = len(ions)
            ions.append(Ion(name, name))
        ranges.append(Range(low, high, known))
    return RangeTable(tuple(ions), tuple(ranges)).checked()


def parse_double_rng(text: str) -> RangeTable:
    """Two stacked sections; ranges in both take ion names and colours of the second."""
    lines = text.splitlines()
    dashed = [k for k, x in enumerate(lines) if x.startswith("--")]
    if len(dashed) < 2:
        raise FormatError("two sections expected")
    start = next((k for k in range(dashed[1] - 1, dashed[0], -1) if re.fullmatch(r"\s*\d+\s+\d+\s*", lines[k])), None)
    if start is None:
        raise FormatError("the second section has no counts")
    one, two = parse_rng("\n".join(lines[:start])), parse_rng("\n".join(lines[start:]))
    ions, taken = list(one.ions), {}
    for r in one.ranges:
        twin = next((s for s in two.ranges if (s.low, s.high) == (r.low, r.high)), None)
        if twin is not None:
            if taken.setdefault(r.ion, twin.ion) != twin.ion:
                raise FormatError("an ion has two replacements")
            ions[r.ion] = two.ions[twin.ion]
    return RangeTable(tuple(ions), one.ranges).checked()


def parse_env(text: str) -> RangeTable:
    """Counts, ``name r g b`` lines, ``name low high ? ?`` lines; charge states fold into one ion."""
    lines = [re.split("[;#]", x)[0].split() for x in text.splitlines()]
    lines = [x for x in lines if x and x != ["Rev_2.0"]]
    if not lines or len(lines[0]) != 2 or not all(w.isdigit() for w in lines[0]):
        raise FormatError("two counts expected")
    strip = lambda name: re.sub(r"_\d*\+*$", "", name)
    ions, ranges = [], []
    for words in lines[1:]:
        if len(words) == 4:
            rgb = tuple(_numbers(words[1:]))
            if not all(0 <= c <= 1 for c in rgb):
                raise FormatError("colours are from 0 to 1")
            if strip(words[0]) not in [i.short for i in ions]:
                ions.append(Ion(strip(words[0]), strip(words[0]), rgb))
        elif len(words) == 5:
            low, high = _numbers(words[1:3])
            known = [k for k, i in enumerate(ions) if i.short == strip(words[0])]
            if not known:
                raise FormatError(f"unknown ion {words[0]}")
            ranges.append(Range(low, high, known[0]))
        else:
            break
    if len(ranges) != int(lines[0][1]):
        raise FormatError("the number of ranges differs")
    return RangeTable(tuple(ions), tuple(ranges)).checked()


def parse_rrng(text: str) -> RangeTable:
    """Sections ``[Ions]`` and ``[Ranges]`` of numbered keys."""
    sections: dict[str, dict[str, str]] = {}
    at = None
    for line in (x.split("#")[0].strip() for x in text.splitlines()):
        if re.fullmatch(r"\[\w+\]", line):
            at = sections.setdefault(line.lower(), {})
        elif "=" in line and at is not None:
            name, _, value = line.partition("=")
            at[name.strip().lower()] = value.strip()
    if not {"[ions]", "[ranges]"} <= sections.keys():
        raise FormatError("two sections expected")
    listed = [v for k, v in sections["[ions]"].items() if k.startswith("ion")]
    rows = [v for k, v in sections["[ranges]"].items() if k.startswith("range")]
    if len(rows) != int(sections["[ranges]"].get("number", -1)) or len(listed) != int(sections["[ions]"].get("number", -1)):
        raise FormatError("a number differs")
    ions: list[Ion] = []
    ranges = []
    for row in rows:
        words = row.split()
        low, high = _numbers(words[:2])
        keys = dict(w.split(":", 1) for w in words[2:] if ":" in w)
        colour = keys.pop("Color", "808080")
        keys.pop("Vol", None)
        plain = keys.pop("Name", "")
        unknown = [k for k in keys if k not in listed]
        if unknown or any(int(v) < 1 for v in keys.values()):
            raise FormatError(f"unknown ion in {row}")
        name = compose([(k, int(v)) for k, v in keys.items()]) or re.sub(r"^\d+", "", plain)
        if not name:
            continue
        if name not in [i.short for i in ions]:
            ions.append(Ion(name, name, tuple(int(colour[k : k + 2], 16) / 255 for k in (0, 2, 4))))
        ranges.append(Range(low, high, [i.short for i in ions].index(name)))
    return RangeTable(tuple(ions), tuple(ranges)).checked()


PARSERS = {"rng": parse_rng, "double_rng": parse_double_rng, "env": parse_env, "rrng": parse_rrng}


def detect(text: str) -> str | None:
    """Format by its marks; None if none fits."""
    lines = text.splitlines()
    low = [x.strip().lower() for x in lines]
    if "[ions]" in low and "[ranges]" in low:
        return "rrng"
    dashed = sum(x.startswith("--") for x in lines)
    if re.fullmatch(r"\s*\d+\s+\d+\s*", lines[0] if lines else "") and dashed:
        return "double_rng" if dashed > 1 else "rng"
    return "env" if any(re.fullmatch(r"\d+\s+\d+", x) for x in low) else None


def parse(text: str) -> tuple[str, RangeTable]:
    """(format, table): the detected format first, then every other."""
    first = detect(text)
    for kind in dict.fromkeys([*([first] if first else []), *PARSERS]):
        try:
            return kind, PARSERS[kind](text)
        except ValueError:
            continue
    raise FormatError("no format fits")


def read(path: str) -> RangeTable:
    if Path(path).stat().st_size > MOST_BYTES:
        raise FormatError("the file is too large for a dictionary")
    return parse(Path(path).read_text())[1]


def _hex(rgb: tuple[float, float, float]) -> str:
    return "".join(f"{round(255 * c):02X}" for c in rgb)


def render(table: RangeTable, kind: str) -> str:
    """The table as a file; colours are those of the ions."""
    if kind == "rng":
        names = "".join(f"{i.long}\n{i.short} {' '.join(f'{c:.6g}' for c in i.rgb)}\n" for i in table.ions)
        rows = "".join(f". {r.low!r} {r.high!r} {' '.join(str(int(k == r.ion)) for k in range(len(table.ions)))}\n" for r in table.ranges)
        return f"{len(table.ions)} {len(table.ranges)}\n{names}------ {' '.join(i.short for i in table.ions)}\n{rows}"
    if kind == "env":
        names = "".join(f"{i.short} {' '.join(f'{c:.6g}' for c in i.rgb)}\n" for i in table.ions)
        rows = "".join(f"{table.ions[r.ion].short} {r.low!r} {r.high!r} 0.0 100.0\n" for r in table.ranges)
        return f"Rev_2.0\n{len(table.ions)} {len(table.ranges)}\n{names}{rows}0 0 0 0 0 0\n"
    if kind == "rrng":
        ions = "".join(f"Ion{k + 1}={i.short}\n" for k, i in enumerate(table.ions))
        rows = "".join(f"Range{k + 1}={r.low!r} {r.high!r} {table.ions[r.ion].short}:1 Color:{_hex(table.ions[r.ion].rgb)}\n" for k, r in enumerate(table.ranges))
        return f"[Ions]\nNumber={len(table.ions)}\n{ions}[Ranges]\nNumber={len(table.ranges)}\n{rows}"
    raise ValueError(kind)


def parse_isotopes(text: str) -> list[tuple[str, int, int, float, float, float, float]]:
    """(symbol, mass number, atomic number, mass, its error, abundance, its error) from XML."""
    out = []
    for entry in ET.fromstring(text).iter("entry"):
        get = lambda name, e=entry: float(e.find(name).get("value")) if e.find(name) is not None else 0.0
        error = lambda name, e=entry: float(e.find(name).get("error", 0)) if e.find(name) is not None else 0.0
        out.append((entry.get("symbol"), int(entry.get("mass-number")), int(entry.get("atomic-number")), get("mass"), error("mass"), get("abundance"), error("abundance")))
    return out
