"""Plans and reports written out: checked JSON, drawings, settings, summaries."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from planspark.sources.files import write_atomic

_MEASURE = {"value": float, "lo": float, "hi": float, "unit": str, "coverage": float}
_POINT = [float]
#: Shape of a plan: sections, types, ``?`` for what may be missing or null, lists by their one element.
PLAN: dict[str, Any] = {
    "schema_version": str,
    "capture": {"tier": str, "source": str},
    "rooms": [{
        "id": str, "label": str, "polygon": [_POINT], "walls": [{"id": str, "start": _POINT, "end": _POINT, "length": _MEASURE}],
        "openings": [{"id": str, "wall_id": str, "type": str, "width": _MEASURE, "offset_along_wall": _MEASURE, "sill_height?": _MEASURE, "connects_to?": str}],
        "ceiling_height?": _MEASURE, "floor_area": _MEASURE, "perimeter": _MEASURE,
    }],
    "adjacency": [{"a": str, "b": str, "via": str}],
    "property": {"footprint_area?": _MEASURE},
    "damage": [{"id": str, "surface_id": str, "class": str, "confidence": float}],
    "concealed_flags": [{"id": str, "surface_id": str, "rule_id": str}],
    "scope": [{"id": str, "surface_id": str, "code": str, "quantity": _MEASURE}],
    "warnings": [str],
}


def problems(value: Any, shape: Any = None, at: str = "plan") -> list[str]:
    """Where a plan departs from its shape; further keys are allowed."""
    shape = PLAN if shape is None else shape
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{at} is no section"]
        out = []
        for name, inner in shape.items():
            key, optional = name.rstrip("?"), name.endswith("?")
            if value.get(key) is None:
                out += [] if optional else [f"{at}.{key} is missing"]
            else:
                out += problems(value[key], inner, f"{at}.{key}")
        return out
    if isinstance(shape, list):
        return [p for i, v in enumerate(value) for p in problems(v, shape[0], f"{at}[{i}]")] if isinstance(value, list) else [f"{at} is no list"]
    if shape is float:
        return [] if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) else [f"{at} is no number"]
    return [] if isinstance(value, shape) else [f"{at} is no {shape.__name__}"]


def empty_plan(tier: str, source: str) -> dict[str, Any]:
    return {"schema_version": "0.1", "capture": {"tier": tier, "source": source}, "rooms": [], "adjacency": [], "property": {}, "damage": [], "concealed_flags": [], "scope": [], "warnings": []}


def write_plan(plan: dict[str, Any], folder: Path, settings: str = "") -> Path:
    """Plan, drawing and settings of a run; a plan that is not of its shape is not written."""
    if wrong := problems(plan):
        raise ValueError("; ".join(wrong[:5]))
    folder.mkdir(parents=True, exist_ok=True)
    write_atomic(folder / "plan.json", json.dumps(plan, indent=1))
    write_atomic(folder / "plan.svg", drawing(plan))
    if settings:
        write_atomic(folder / "config.resolved.yaml", settings)
    return folder / "plan.json"


def summary(plan: dict[str, Any]) -> list[str]:
    """Console lines: a line a room, then the warnings."""
    lines = []
    for r in plan["rooms"]:
        high = r.get("ceiling_height")
        lines.append(f"{r['id']}: {r['floor_area']['value']:.2f} m2, {len(r['walls'])} walls, ceiling {'not observed' if high is None else format(high['value'], '.3f') + ' m'}")
    return lines + [f"! {w}" for w in plan["warnings"]]


def write_results(rows: list[dict[str, Any]], path: Path, **about: Any) -> Path:
    """Result rows of an experiment, with what they are about, as one JSON file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    write_atomic(path, json.dumps({**about, "rows": rows}, indent=1, sort_keys=True))
    return path


def with_half(m: dict[str, Any] | None, unit: str) -> str:
    return f"{m['value']:.2f} ±{(m['hi'] - m['lo']) / 2:.2f} {unit}" if m else "n/a"


COLOURS = ("#3b6ea5", "#c46a1b", "#3f8f4e", "#8a5a9c", "#b8434a", "#4f9a96")


class Sheet:
    """A drawing in plan metres: v grows up in the plan and down on the sheet."""

    def __init__(self, points: list[tuple[float, float]], scale: float, margin: float):
        us, vs = zip(*points, strict=True) if points else ((0.0,), (0.0,))
        self.scale, self.left, self.top = scale, min(us) - margin, max(vs) + margin
        self.width, self.height = (max(us) + margin - self.left) * scale, (self.top - min(vs) + margin) * scale
        self.marks: list[str] = []

    def at(self, p) -> tuple[float, float]:
        return (p[0] - self.left) * self.scale, (self.top - p[1]) * self.scale

    def mark(self, name: str, text: str = "", **attributes: Any) -> None:
        own = " ".join(f'{k.replace("_", "-")}="{v:.1f}"' if isinstance(v, float) else f'{k.replace("_", "-")}="{v}"' for k, v in attributes.items())
        body = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        self.marks.append(f"<{name} {own}>{body}</{name}>" if body else f"<{name} {own}/>")

    def ring(self, polygon, **attributes: Any) -> None:
        self.mark("polygon", points=" ".join(f"{x:.1f},{y:.1f}" for x, y in map(self.at, polygon)), **attributes)

    def stroke(self, a, b, **attributes: Any) -> None:
        (x1, y1), (x2, y2) = self.at(a), self.at(b)
        self.mark("line", x1=x1, y1=y1, x2=x2, y2=y2, **attributes)

    def say(self, p, text: str, down: float = 0.0, **attributes: Any) -> None:
        x, y = self.at(p)
        self.mark("text", text, x=x, y=y + down, text_anchor="middle", **attributes)

    def svg(self) -> str:
        size = f'width="{self.width:.0f}" height="{self.height:.0f}" viewBox="0 0 {self.width:.0f} {self.height:.0f}"'
        return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif">', '<rect width="100%" height="100%" fill="white"/>', *self.marks, "</svg>"])


def _along(wall: dict[str, Any], metres: float) -> tuple[float, float]:
    (u, v), (u2, v2) = wall["start"], wall["end"]
    length = max(math.hypot(u2 - u, v2 - v), 1e-9)
    return u + (u2 - u) / length * metres, v + (v2 - v) / length * metres


def drawing(plan: dict[str, Any], scale: float = 80.0, margin: float = 1.0) -> str:
    """A plan as SVG: rooms, wall lengths, openings, damage on walls and floors, areas, ceilings and totals."""
    sheet = Sheet([tuple(p) for r in plan["rooms"] for p in r["polygon"]], scale, margin)
    for k, room in enumerate(plan["rooms"]):
        joined = room.get("connected", True)
        colour = COLOURS[k % len(COLOURS)] if joined else "#888888"
        sheet.ring(room["polygon"], fill=colour, fill_opacity=0.1, stroke="#222222" if joined else colour, stroke_width=3 if joined else 2, **({} if joined else {"stroke_dasharray": "8 5"}))
        by_id = {w["id"]: w for w in room["walls"]}
        for w in room["walls"]:
            middle = [(a + b) / 2 for a, b in zip(w["start"], w["end"], strict=True)]
            x, y = sheet.at(middle)
            lean = math.degrees(math.atan2(w["start"][1] - w["end"][1], w["end"][0] - w["start"][0]))
            lean -= 180 * (lean > 90) - 180 * (lean < -90)
            sheet.say(middle, f"{w['length']['value']:.2f}", font_size=11, transform=f"rotate({lean:.1f} {x:.1f} {y:.1f}) translate(0 -5)")
        for o in room.get("openings", []):
            if (w := by_id.get(o["wall_id"])) is not None:
                first = o["offset_along_wall"]["value"]
                a, b = _along(w, first), _along(w, first + o["width"]["value"])
                own = {"window": "#3b6ea5", "door": "#a4501d"}.get(o["type"], "#3f8f4e")
                sheet.stroke(a, b, stroke="white", stroke_width=5)
                sheet.stroke(a, b, stroke=own, stroke_width=2, stroke_dasharray="4 3")
                sheet.say([(p + q) / 2 for p, q in zip(a, b, strict=True)], f"{o['type']} {o['width']['value']:.2f}", -7, font_size=10, fill=own)
        centre = [sum(c) / len(room["polygon"]) for c in zip(*room["polygon"], strict=True)]
        lines = [(room["label"] + ("" if joined else " (not connected)"), {"font_size": 14, "font_weight": "bold", "fill": colour}), (with_half(room["floor_area"], "m²"), {"font_size": 11}), ("ceiling " + with_half(room.get("ceiling_height"), "m"), {"font_size": 11})]
        for d in plan.get("damage", []):
            name = f"{d['id']} {d['class'].replace('_', ' ')}"
            span = [p[0] for p in d.get("polygon_on_surface", [])]
            if (w := by_id.get(d["surface_id"])) is not None and span:
                a, b = _along(w, min(span)), _along(w, max(span))
                sheet.stroke(a, b, stroke="#c62828", stroke_width=7, stroke_opacity=0.8)
                sheet.say([(p + q) / 2 for p, q in zip(a, b, strict=True)], name, 16, font_size=10, fill="#c62828")
            elif w is None and d["surface_id"].startswith(room["id"] + "."):
                lines.append((f"{name} on {d['surface_id'].rpartition('.')[2]}", {"font_size": 10, "fill": "#c62828"}))
        for i, (text, look) in enumerate(lines):
            sheet.say(centre, text, 15 * i, **look)
    total = f"{plan['capture']['tier']} · footprint {with_half(plan['property'].get('footprint_area'), 'm²')} · {len(plan['rooms'])} rooms"
    apart = sum(not r.get("connected", True) for r in plan["rooms"])
    notes = [total, f"{len(plan['damage'])} damage regions · {len(plan['concealed_flags'])} flags · {len(plan['scope'])} scope items", *([f"{apart} room(s) measured but not placed"] if apart else [])]
    for i, text in enumerate(notes):
        sheet.mark("text", text, x=12, y=20 + 17 * i, font_size=12)
    return sheet.svg()
