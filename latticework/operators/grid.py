"""Particle-grid transfers with quadratic B-spline stencils, and grid updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.materials import pressure
from ..functions.vectors import base_node, bspline
from .lineage import cut


def stencil(particles: DataFrame, dx: float) -> DataFrame:
    """A row for each of the 3 x 3 nodes around a particle (id, x, y, ..): node, weight, offset to it."""
    out = particles
    for a in ("x", "y"):
        at = F.col(a) / dx
        base = base_node(at, 2)
        w = bspline(at - base, 2)
        nodes = F.array(*[F.struct((base + k).alias("node"), w[k].alias("w"), ((base + k) * F.lit(dx) - F.col(a)).alias("d")) for k in range(3)])
        out = out.withColumn(f"__{a}", F.explode(nodes))
    return out.withColumns({"i": F.col("__x.node"), "j": F.col("__y.node"), "w": F.col("__x.w") * F.col("__y.w"), "rx": F.col("__x.d"), "ry": F.col("__y.d")}).drop("__x", "__y")


def gathered(particles: DataFrame, grid: DataFrame, dx: float, nodes: str, values: dict[str, Column], slopes: bool = False) -> DataFrame:
    """Particles with, of each of `values`, its sum over the nodes around them by weight; with `slopes` also, as `<name>_<axis>`, by
    weight and offset to the node along an axis. A value is what its expression makes of null where the grid has no node;
    `nodes` names the axes of the grid, in the order of x, y, z. A null coordinate gives nulls.

    The nodes around a cell are put together once, for each cell that holds a particle, and meet the particles by the cell: a
    particle is never copied to its nodes, and a small table of cells is broadcast. Sums are taken in Arrow batches."""
    axes, names, size = "xyz"[: len(nodes)], list(values), 3 ** len(nodes)
    bases = [f"__b{a}" for a in axes]
    placed = particles.withColumns({b: base_node(F.col(a) / dx, 2) for a, b in zip(axes, bases, strict=True)})
    around = placed.select(*bases).distinct().withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    around = around.withColumns({n: F.col(b) + F.floor(F.col("__o") / 3 ** (len(axes) - 1 - k)).cast("long") % 3 for k, (n, b) in enumerate(zip(nodes, bases, strict=True))})
    around = around.join(grid, list(nodes), "left").select(*bases, F.struct("__o", F.array(*values.values()).alias("v")).alias("__v"))
    cells = cut(around.groupBy(*bases).agg(F.flatten(F.array_sort(F.collect_list("__v"))["v"]).alias("__cell")))
    held = F.coalesce("__cell", F.array_repeat(F.lit(0.0), size * len(names))).alias("__cell")
    placed = placed.join(cells, bases, "left").select(*particles.columns, *[F.col(a).cast("double").alias(f"__{a}") for a in axes], *[F.col(b).cast("double").alias(b) for b in bases], held)
    own = particles.schema.fields
    made = names + ([f"{n}_{a}" for n in names for a in axes] if slopes else [])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            by = lambda v, w: (v * w.reshape(n, *[1] * (v.ndim - 3), 3, 1)).sum(axis=-2)  # noqa: E731  the last axis of nodes
            at = [batch.column(f"__{a}").to_numpy(zero_copy_only=False) for a in axes]
            base = [batch.column(b).to_numpy(zero_copy_only=False) for b in bases]
            lost = np.any([batch.column(f"__{a}").is_null().to_numpy(zero_copy_only=False) for a in axes], axis=0)
            f = [x / dx - b for x, b in zip(at, base, strict=True)]
            w = [np.stack(bspline(x, 2), axis=1) for x in f]
            r = [np.stack([(b + k) * dx - x for k in range(3)], axis=1) for x, b in zip(at, base, strict=True)]
            v = batch.column("__cell").flatten().to_numpy(zero_copy_only=False).reshape(n, *[3] * len(axes), len(names))
            plain, sloped = v, {}
            for k in reversed(range(len(axes))):
                sloped = {a: by(x, w[k]) for a, x in sloped.items()} | ({axes[k]: by(plain, w[k] * r[k])} if slopes else {})
                plain = by(plain, w[k])
            out = [plain[:, q] for q in range(len(names))] + ([sloped[a][:, q] for q in range(len(names)) for a in axes] if slopes else [])
            yield pa.RecordBatch.from_arrays([*[batch.column(c.name) for c in own], *[pa.array(x, mask=lost) for x in out]], names=[*[c.name for c in own], *made])

    return placed.mapInArrow(run, StructType([*own, *[StructField(c, DoubleType()) for c in made]]))


def particles_to_grid(particles: DataFrame, dx: float) -> DataFrame:
    """(i, j, m, mvx, mvy) from particles (id, x, y, m, vx, vy)."""
    s = stencil(particles, dx)
    wm = F.col("w") * F.col("m")
    return s.groupBy("i", "j").agg(F.sum(wm).alias("m"), F.sum(wm * F.col("vx")).alias("mvx"), F.sum(wm * F.col("vy")).alias("mvy"))


def stencil_3d(particles: DataFrame, dx: float) -> DataFrame:
    """A row for each of the 3 x 3 x 3 nodes around a particle (x, y, z, ..): node i, j, k, weight w, offset rx, ry, rz to it."""
    out = particles
    for a, n in zip("xyz", "ijk", strict=True):
        at = F.col(a) / dx
        base = base_node(at, 2)
        w = bspline(at - base, 2)
        nodes = F.array(*[F.struct((base + c).alias(n), w[c].alias("w"), ((base + c) * F.lit(dx) - F.col(a)).alias("d")) for c in range(3)])
        out = out.withColumn(f"__{a}", F.explode(nodes))
    named = {n: F.col(f"__{a}.{n}") for a, n in zip("xyz", "ijk", strict=True)} | {f"r{a}": F.col(f"__{a}.d") for a in "xyz"}
    return out.withColumns(named | {"w": F.col("__x.w") * F.col("__y.w") * F.col("__z.w")}).drop("__x", "__y", "__z")


def fluid_stress(volume: float, bulk: float, viscosity: float) -> list[Column]:
    """Stress times volume, column by column, of particles with c0 .. c8 and volume ratio `ratio`."""
    c, j = [F.col(f"c{n}") for n in range(9)], F.col("ratio")
    p = pressure(j, F.lit(bulk))
    return [((c[3 * q + r] + c[3 * r + q]) * viscosity - (p if q == r else F.lit(0.0))) * (volume * j) for q in range(3) for r in range(3)]


def affine_particles_to_grid(particles: DataFrame, dx: float, dt: float, stress: list[Column] | None = None) -> DataFrame:
    """(i, j, k, m, mvx, mvy, mvz, fx, fy, fz) from particles (id, x, y, z, m, vx, vy, vz, c0 .. c8): mass, momentum with the
    affine part C (xi - xp), and the impulse of `stress` (times volume; none: 0). Matrices go column by column."""
    own = particles.withColumns({f"__s{n}": F.lit(0.0) if stress is None else stress[n] * (-dt * 4 / (dx * dx)) for n in range(9)})
    s = stencil_3d(own, dx)
    r, w = [F.col("rx"), F.col("ry"), F.col("rz")], F.col("w")
    times = lambda m, d: sum((F.col(f"{m}{d + 3 * q}") * r[q] for q in (1, 2)), F.col(f"{m}{d}") * r[0])
    sums = [F.sum(w * F.col("m") * (F.col(f"v{a}") + times("c", d))).alias(f"mv{a}") for d, a in enumerate("xyz")]
    return s.groupBy("i", "j", "k").agg(F.sum(w * F.col("m")).alias("m"), *sums, *[F.sum(w * times("__s", d)).alias(f"f{a}") for d, a in enumerate("xyz")])


def affine_velocity(grid: DataFrame) -> DataFrame:
    """The same grid with vx, vy, vz: momentum and impulse over mass, 0 where there is none."""
    return grid.withColumns({f"v{a}": F.when(F.col("m") != 0, (F.col(f"mv{a}") + F.col(f"f{a}")) / F.when(F.col("m") != 0, F.col("m"))).otherwise(0.0) for a in "xyz"})


def affine_grid_to_particles(particles: DataFrame, grid: DataFrame, dx: float, dt: float) -> DataFrame:
    """Particles with v and C gathered from (i, j, k, vx, vy, vz), places moved by v, and the volume ratio `ratio` and the
    deformation gradient f0 .. f8, where they have them, updated by C. Other columns are dropped."""
    has = lambda *c: [n for n in c if n in particles.columns]
    state = has("x", "y", "z", "ratio", *[f"f{n}" for n in range(9)])
    g = gathered(particles.select("id", *state), grid, dx, "ijk", {f"__v{a}": F.coalesce(f"v{a}", F.lit(0.0)) for a in "xyz"}, slopes=True)
    g = g.select("id", *state, *[F.col(f"__v{a}").alias(f"v{a}") for a in "xyz"], *[(F.col(f"__v{'xyz'[n % 3]}_{'xyz'[n // 3]}") * (4 / (dx * dx))).alias(f"c{n}") for n in range(9)])
    moved = {a: F.col(a) + F.col(f"v{a}") * dt for a in "xyz"}
    if "ratio" in state:
        moved["ratio"] = (1 + (F.col("c0") + F.col("c4") + F.col("c8")) * dt) * F.col("ratio")
    if "f0" in state:
        step = [F.col(f"c{n}") * dt + (0.0 if n % 4 else 1.0) for n in range(9)]
        moved |= {f"f{r + 3 * q}": sum((step[r + 3 * k] * F.col(f"f{k + 3 * q}") for k in (1, 2)), step[r] * F.col(f"f{3 * q}")) for q in range(3) for r in range(3)}
    return g.withColumns(moved)


def momentum_to_velocity(grid: DataFrame, fx: float = 0.0, fy: float = 0.0, dt: float = 0.0) -> DataFrame:
    part = lambda c, f: F.when(F.col("m") != 0, F.col(c) / F.when(F.col("m") != 0, F.col("m")).otherwise(1.0) + f * dt).otherwise(0.0)
    return grid.withColumns({"vx": part("mvx", fx), "vy": part("mvy", fy)})


def grid_to_particles(particles: DataFrame, grid: DataFrame, dx: float, dt: float) -> DataFrame:
    """Velocities gathered from (i, j, vx, vy) and places moved by them."""
    sums = gathered(particles.select("id", "x", "y"), grid, dx, "ij", {a: F.coalesce(a, F.lit(0.0)) for a in ("vx", "vy")})
    return sums.select("id", (F.col("x") + F.col("vx") * dt).alias("x"), (F.col("y") + F.col("vy") * dt).alias("y"), "vx", "vy")


def sample(grid: DataFrame, points: DataFrame, dx: float, value: str, background: float) -> DataFrame:
    """(id, value): a node property at points, nodes that are not there having the background value."""
    return gathered(points.select("id", "x", "y"), grid, dx, "ij", {value: F.coalesce(value, F.lit(background))}).select("id", value)


def angular_momentum(grid: DataFrame) -> DataFrame:
    live = grid.where("m <> 0")
    return live.agg(F.sum("mvx").alias("px"), F.sum("mvy").alias("py"), F.sum(F.col("i") * F.col("mvy") - F.col("j") * F.col("mvx")).alias("l"))


def flood_fill(seeds: DataFrame, passable: DataFrame) -> DataFrame:
    """Cells (i, j) of `passable` reached from `seeds` through shared sides."""
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    seen = cut(seeds.join(passable, ["i", "j"], "left_semi").select("i", "j").distinct())
    front = seen
    while not front.isEmpty():
        near = front.withColumn("o", F.explode(steps)).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j")).distinct()
        front = cut(near.join(passable, ["i", "j"], "left_semi").join(seen, ["i", "j"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def clean(grid: DataFrame, *channels: str) -> DataFrame:
    """Channels of all nodes set to 0."""
    return grid.withColumns({c: F.lit(0.0) for c in channels})


def mark(grid: DataFrame, live: Column, out: str = "mark") -> DataFrame:
    return grid.withColumn(out, F.when(live, 1).otherwise(0))


def refit(grid: DataFrame, marked: str = "mark") -> DataFrame:
    """Only the nodes that are marked."""
    return grid.where(F.col(marked) != 0)


def extend(cells: DataFrame, layers: int) -> DataFrame:
    """Cells (i, j) with all that are within so many layers, corners included, each once."""
    reach = range(-layers, layers + 1)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in reach for b in reach])
    return cells.withColumn("o", F.explode(steps)).select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).distinct()


def speed(channels: list[str]) -> Column:
    """The largest part of a velocity by size."""
    return F.greatest(*[F.abs(c) for c in channels])


def grid_to_particles_to_grid(particles: DataFrame, grid: DataFrame, dx: float, dt: float, stress: list[Column] | None = None) -> DataFrame:
    """A step that gathers velocities and C from the grid, moves the particles and scatters them again."""
    moved = affine_grid_to_particles(particles, grid, dx, dt)
    mass = particles.select("id", "m")
    return affine_particles_to_grid(moved.join(mass, "id"), dx, dt, stress)


def blend(pic: DataFrame, old: DataFrame, before: DataFrame, dx: float, ratio: float) -> DataFrame:
    """FLIP: (id, vx, vy, vz): the particle's own velocity with the grid's change added, blended with the grid's
    (`pic`, after the step) by `ratio`; `old` has the particles, `before` the grid before the step."""
    was = affine_grid_to_particles(old, before, dx, 0.0).select("id", *[F.col(f"v{a}").alias(f"w{a}") for a in "xyz"])
    both = pic.select("id", *[f"v{a}" for a in "xyz"]).join(was, "id").join(old.select("id", *[F.col(f"v{a}").alias(f"u{a}") for a in "xyz"]), "id")
    return both.select("id", *[((F.col(f"u{a}") + F.col(f"v{a}") - F.col(f"w{a}")) * ratio + F.col(f"v{a}") * (1 - ratio)).alias(f"v{a}") for a in "xyz"])
