"""The engine in SQL text: models and geometry as functions of a session, and the control grid as a table function.

    register(spark)
    SELECT xg(x, y, goal_x, defenders, speed), xt(x, y, direction), iou(...), project(u, v, h).x ...
    SELECT * FROM voronoi_cells(TABLE(positions) PARTITION BY (match_id, frame_idx))

The scalar functions are SQL functions made from the same Column expressions, so
they are inlined into the plan: no Python, and filters and columns still reach
the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from . import geometry as G, models as M


def _functions() -> dict[str, tuple[str, str, Column]]:
    """name: (parameters, type, expression over the parameters)."""
    box = lambda p: [f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2"]
    doubles = lambda names: ", ".join(f"{n} double" for n in names)
    row, col = M.threat_zone("x", "y", "direction")
    h = [F.get(F.col("h"), F.lit(i)) for i in range(9)]
    px, py = G.project("u", "v", h)
    return {
        "goal_distance": (doubles(["x", "y", "goal_x"]), "double", M.goal_distance("x", "y", "goal_x")),
        "goal_angle": (doubles(["x", "y", "goal_x"]), "double", M.goal_angle("x", "y", "goal_x")),
        "xg": (doubles(["x", "y", "goal_x", "defenders", "speed"]), "double", M.expected_goals(M.goal_distance("x", "y", "goal_x"), M.goal_angle("x", "y", "goal_x"), "defenders", "speed")),
        "xt": (doubles(["x", "y", "direction"]), "double", M.zone_threat(row, col)),
        "iou": (doubles([*box("a"), *box("b")]), "double", G.iou(box("a"), box("b"))),
        "project": ("u double, v double, h array<double>", "struct<x: double, y: double>", F.struct(px.alias("x"), py.alias("y"))),
        "activity": (doubles(["speed"]), "string", M.activity("speed")),
    }


class VoronoiCells:
    """Owner (0 or 1) of each cell of the pitch, of the rows (x_m, y_m, role_id) of one partition, as one Arrow table; nothing unless both sides are there."""

    def __init__(self):
        self.points = {0: [], 1: []}
        self.key = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.key = rows.column("match_id")[0].as_py(), rows.column("frame_idx")[0].as_py()
        for role, x, y in zip(*(rows.column(c).to_pylist() for c in ("role_id", "x_m", "y_m")), strict=True):
            side = {0: 0, 3: 0, 1: 1, 4: 1}.get(role)
            if side is not None and x is not None and y is not None:
                self.points[side].append((float(x), float(y)))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        import numpy as np

        from ..operators import space

        if not all(self.points.values()):
            return
        a, b = (np.array(self.points[s], float).T for s in (0, 1))
        owner = np.where(space.nearest_side(*a, *b), 0, 1)
        n = len(owner)
        match, frame = (pa.repeat(pa.scalar(k, pa.int64()), n) for k in self.key)
        yield pa.table({"match_id": match, "frame_idx": frame, **{c: pa.array(v.astype(np.int32)) for c, v in (("gx", space._GX), ("gy", space._GY), ("owner", owner))}})


def register(spark: SparkSession) -> None:
    """Adds the functions to a session."""
    for name, (parameters, kind, column) in _functions().items():
        plan = spark.createDataFrame([], parameters).select(column.alias("v"))._jdf.queryExecution().analyzed()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {plan.expressions().head().child().sql()}")
    cells = F.arrow_udtf(VoronoiCells, returnType="match_id long, frame_idx long, gx int, gy int, owner int")
    spark.udtf.register("voronoi_cells", cells)
