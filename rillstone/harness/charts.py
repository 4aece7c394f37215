"""Charts of measured runs as SVG text: bars by engine, and a strip of a sweep's variants."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from html import escape

_COLOURS = ("#3b6fb6", "#d1793b", "#5a9e6f", "#8d6bb0", "#b0524f", "#7a7a7a")
_FRAME = '<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="11">\n<rect width="100%" height="100%" fill="white"/>\n{body}\n</svg>\n'


def _log_scale(values: Sequence[float], low_px: float, high_px: float):
    """From positive values to pixels, by logarithm; whole decades."""
    low = math.floor(math.log10(min(values)))
    high = max(low + 1, math.ceil(math.log10(max(values))))
    return (lambda v: low_px + (math.log10(v) - low) / (high - low) * (high_px - low_px)), [10.0**k for k in range(low, high + 1)]


def slowdown_order(rows: Mapping[str, Mapping[str, float | None]], base: str) -> list[str]:
    """Names by the mean slowdown of the other engines over `base`, largest first; rows without one last."""

    def key(name: str) -> tuple[bool, float, str]:
        own = rows[name].get(base)
        ratios = [v / own for engine, v in rows[name].items() if engine != base and v and own]
        return (not ratios, -(sum(ratios) / len(ratios)) if ratios else 0.0, name)

    return sorted(rows, key=key)


def bars(rows: Mapping[str, Mapping[str, float | None]], base: str, title: str, unit: str = "s") -> str:
    """A group of bars for each row, one for each engine, on a logarithmic axis; a missing value is a cross."""
    names = slowdown_order(rows, base)
    engines = sorted({e for r in rows.values() for e in r}, key=lambda e: (e != base, e))
    values = [v for r in rows.values() for v in r.values() if v]
    if not values:
        return _FRAME.format(w=200, h=40, body=f'<text x="10" y="24">{escape(title)}: nothing measured</text>')
    group, left, top, height = 12 * len(engines) + 14, 60, 40, 220
    scale, ticks = _log_scale(values, top + height, top)
    body = [f'<text x="{left}" y="18" font-size="13">{escape(title)} ({escape(unit)})</text>']
    width = left + group * len(names) + 20
    for t in ticks:
        body.append(f'<line x1="{left}" x2="{width - 20}" y1="{scale(t):.1f}" y2="{scale(t):.1f}" stroke="#ddd"/><text x="{left - 6}" y="{scale(t) + 4:.1f}" text-anchor="end">{t:g}</text>')
    for i, name in enumerate(names):
        x = left + group * i + 7
        for k, engine in enumerate(engines):
            v = rows[name].get(engine)
            if v:
                body.append(f'<rect x="{x + 12 * k}" y="{scale(v):.1f}" width="10" height="{top + height - scale(v):.1f}" fill="{_COLOURS[k % len(_COLOURS)]}"><title>{escape(f"{name} {engine}: {v:g} {unit}")}</title></rect>')
            else:
                body.append(f'<text x="{x + 12 * k + 5}" y="{top + height - 3}" text-anchor="middle" fill="{_COLOURS[k % len(_COLOURS)]}">×</text>')
        body.append(f'<text x="{x}" y="{top + height + 14}" transform="rotate(35 {x} {top + height + 14})">{escape(name)}</text>')
    for k, engine in enumerate(engines):
        body.append(f'<rect x="{left + 90 * k}" y="24" width="10" height="10" fill="{_COLOURS[k % len(_COLOURS)]}"/><text x="{left + 90 * k + 14}" y="33">{escape(engine)}</text>')
    return _FRAME.format(w=width, h=top + height + 90, body="\n".join(body))


def strip(seconds: Mapping[str, float], default: str = "default", title: str = "plans") -> str:
    """A mark for each variant on one logarithmic axis of seconds, the default's in another colour."""
    if not seconds:
        return _FRAME.format(w=200, h=40, body=f'<text x="10" y="24">{escape(title)}: nothing measured</text>')
    scale, ticks = _log_scale(list(seconds.values()), 60, 640)
    body = [f'<text x="60" y="18" font-size="13">{escape(title)} (s)</text>']
    body += [f'<line x1="{scale(t):.1f}" x2="{scale(t):.1f}" y1="30" y2="90" stroke="#ddd"/><text x="{scale(t):.1f}" y="104" text-anchor="middle">{t:g}</text>' for t in ticks]
    for k, (name, s) in enumerate(sorted(seconds.items(), key=lambda x: (x[0] == default, x[1]))):
        own = name == default
        body.append(f'<circle cx="{scale(s):.1f}" cy="{60 if own else 45 + 30 * (k * 0.618 % 1):.1f}" r="{6 if own else 3}" fill="{_COLOURS[1 if own else 0]}" fill-opacity="0.7"><title>{escape(f"{name}: {s:g} s")}</title></circle>')
    return _FRAME.format(w=700, h=120, body="\n".join(body))
