"""Grids, cameras and regions, from code or from YAML documents (nested or flat)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Grid:
    center: tuple[float, float, float]
    size: tuple[float, float, float]
    shape: tuple[int, int, int]
    name: str = "grid"
    fields: tuple[str, ...] = ("gas_density",)

    @property
    def cell(self) -> tuple[float, ...]:
        return tuple(s / n for s, n in zip(self.size, self.shape, strict=True))

    @property
    def low(self) -> tuple[float, ...]:
        return tuple(c - s / 2 for c, s in zip(self.center, self.size, strict=True))


@dataclass(frozen=True)
class Region:
    center: tuple[float, float, float]
    size: tuple[float, float, float]
    radius: float = 0.0
    margin: float = 0.0
    name: str = "region"


@dataclass(frozen=True)
class Camera:
    position: tuple[float, float, float]
    look_at: tuple[float, float, float]
    up: tuple[float, float, float] = (0.0, 0.0, 1.0)
    kind: str = "orthographic"
    width: int = 1024
    height: int = 1024
    ortho_width: float = 1000.0
    fov: float = 60.0
    slab: float = 0.0
    cam_id: int = 0

    def basis(self) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
        """right, up, forward."""
        unit = lambda v: tuple(x / math.sqrt(sum(y * y for y in v)) for x in v)
        cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        f = unit([b - a for a, b in zip(self.position, self.look_at, strict=True)])
        r = unit(cross(f, self.up))
        return r, unit(cross(r, f)), f

    @property
    def half(self) -> tuple[float, float]:
        """Half extents: lengths of an orthographic view, tangents of a perspective one. The setting is the vertical one."""
        v = self.ortho_width / 2 if self.kind == "orthographic" else math.tan(math.radians(self.fov) / 2)
        return v * self.width / self.height, v


@dataclass(frozen=True)
class Projection:
    field: str = "gas_density"
    mode: str = "column"


@dataclass
class Document:
    """Keys of a YAML document with sections taken apart; the first of a name holds."""

    values: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Document:
        import yaml

        out: dict = {}

        def take(node: dict) -> None:
            for k, v in node.items():
                take(v) if isinstance(v, dict) else out.setdefault(k, v)

        take(yaml.safe_load(text) or {})
        return cls(out)

    def triple(self, name: str, other: str, default: float) -> tuple:
        v = self.values.get(name, self.values.get(other, default))
        return tuple(v) if isinstance(v, list) else (v,) * 3

    def grid(self) -> Grid:
        v = self.values
        return Grid(tuple(map(float, v["center"])), tuple(map(float, self.triple("size", "side", 0))), tuple(map(int, self.triple("resolution", "shape", 1))), v.get("name", "grid"), tuple(v.get("fields", ("gas_density",))))

    def region(self) -> Region:
        r = float(self.values.get("radius", 0))
        return Region(tuple(map(float, self.values["center"])), tuple(map(float, self.triple("size", "side", 2 * r))), r, float(self.values.get("margin", 0)), str(self.values.get("name", "region")))

    def camera(self) -> Camera:
        v, d = self.values, Camera((0, 0, 0), (0, 0, 1), (0, 1, 0))
        return Camera(tuple(v["position"]), tuple(v["look_at"]), tuple(v.get("up", (0.0, 0.0, 1.0))), v.get("type", d.kind), int(v.get("image_width", d.width)), int(v.get("image_height", d.height)), float(v.get("ortho_width", d.ortho_width)), float(v.get("fov", d.fov)), float(v.get("los_slab", 0)))

    def projections(self) -> list[Projection]:
        return [Projection(**p) for p in self.values.get("projections") or []] or [Projection()]


def camera_list(text: str) -> list[list[str]]:
    """Lines of a camera list, split at white space; blank lines and comments go."""
    return [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
