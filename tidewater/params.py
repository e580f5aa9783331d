"""Request parameters: parsing, clamping and guards."""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

# Limits of requests.
MAX_DAYS, MAX_GLOBAL_DAYS, MAX_BOX_DEG2, MAX_HOVER_WINDOWS, MAX_RADIUS_KM = 92, 31, 2500.0, 6, 100.0
PRESETS = {"6h": 6, "12h": 12, "24h": 24, "48h": 48, "7d": 168, "30d": 720, "90d": 2160}
MAX_POLYGONS, MAX_VERTICES = 10, 1000
MAX_WINDOWS = 500
IMMUTABLE_AFTER = timedelta(hours=24)
# Lowest, highest and default value of the clamped parameters.
CLAMPED = {"grid": (0.02, 1.0, 0.1), "gap_minutes": (1.0, 120.0, 30.0), "max_points": (1.0, 50_000.0, 4_000.0), "limit": (1.0, 10_000.0, 1_000.0)}


class RequestError(ValueError):
    """A request outside its limits; ``code`` names the limit."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime

    @property
    def seconds(self) -> int:
        return max(1, math.floor((self.end - self.start).total_seconds()))


def clamp(value: float | None, low: float, high: float, default: float) -> float:
    return default if value is None or not math.isfinite(value) else min(max(value, low), high)


def clamped(name: str, value: float | None) -> float:
    """A parameter inside its limits; what is missing or no finite number is the default."""
    return clamp(value, *CLAMPED[name])


def immutable(end: datetime, now: datetime) -> bool:
    """Whether a window ended so long ago that its result no longer changes."""
    return end < now - IMMUTABLE_AFTER


def instant(text: str) -> datetime:
    """An ISO instant with a zone; anything else is an error."""
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise RequestError("bad_instant", f"not an ISO instant: {text}") from e
    if at.tzinfo is None:
        raise RequestError("bad_instant", f"an instant needs a zone: {text}")
    return at.astimezone(UTC)


def period(start: str | None, end: str | None, preset: str | None, now: datetime) -> Period:
    """A stated period, or the one before ``now`` that a preset names."""
    if preset:
        if preset not in PRESETS:
            raise RequestError("bad_window", f"unknown window {preset}")
        return Period(now - timedelta(hours=PRESETS[preset]), now)
    if not start or not end:
        raise RequestError("missing_window", "from and to are needed")
    found = Period(instant(start), instant(end))
    if found.end <= found.start:
        raise RequestError("bad_window", "to must be after from")
    return found


def bbox(text: str) -> tuple[float, float, float, float]:
    try:
        a, b, c, d = (float(x) for x in text.split(","))
    except ValueError as e:
        raise RequestError("bad_bbox", "bbox is minLon,minLat,maxLon,maxLat") from e
    if not (-180 <= a < c <= 180 and -90 <= b < d <= 90):
        raise RequestError("bad_bbox", "bbox is out of range")
    return a, b, c, d


def guard_heatmap(p: Period, box: tuple[float, float, float, float] | None) -> None:
    days = (p.end - p.start).total_seconds() / 86_400
    if days > MAX_DAYS:
        raise RequestError("window_too_long", f"at most {MAX_DAYS} days")
    if box is None and days > MAX_GLOBAL_DAYS:
        raise RequestError("window_too_long", f"at most {MAX_GLOBAL_DAYS} days without a bbox")
    if box and (box[2] - box[0]) * (box[3] - box[1]) > MAX_BOX_DEG2:
        raise RequestError("bbox_too_large", f"at most {MAX_BOX_DEG2:g} square degrees")


def guard_hover(windows: list[Period], radius_km: float) -> None:
    if not 0 < radius_km <= MAX_RADIUS_KM:
        raise RequestError("bad_radius", f"radius is over 0 and at most {MAX_RADIUS_KM:g} km")
    if not 1 <= len(windows) <= MAX_HOVER_WINDOWS:
        raise RequestError("bad_windows", f"1 to {MAX_HOVER_WINDOWS} windows")
    ordered = sorted(windows, key=lambda w: w.start)
    if any(a.end > b.start for a, b in zip(ordered, ordered[1:], strict=False)):
        raise RequestError("overlapping_windows", "windows must not overlap")


def polygons(geojson: str) -> list[list[tuple[float, float]]]:
    """Outer rings of a Polygon or MultiPolygon, closed; holes go."""
    shape = json.loads(geojson)
    outer = {"Polygon": lambda c: [c[0]], "MultiPolygon": lambda c: [p[0] for p in c]}.get(shape.get("type"))
    if outer is None:
        raise RequestError("bad_polygon", "a Polygon or MultiPolygon is needed")
    rings = [[(float(x), float(y)) for x, y, *_ in ring] for ring in outer(shape["coordinates"])]
    rings = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
    if len(rings) > MAX_POLYGONS or sum(map(len, rings)) > MAX_VERTICES or any(len(r) < 4 for r in rings):
        raise RequestError("bad_polygon", f"1 to {MAX_POLYGONS} rings with {MAX_VERTICES} vertices at most")
    return rings


def encode_cursor(*values: object) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple:
    try:
        return tuple(json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))
    except ValueError as e:
        raise RequestError("bad_cursor", "not a cursor") from e
