"""A river in dated scenes: one object that chains the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meandra.functions.scalar import normalized_difference
from meandra.operators import belts, mapping, paths, polygons, temporal
from meandra.operators.graph import checkpointed


class River:
    """Scenes of one river as cells (scene, row, col, water) and their ends; results are DataFrames, made when asked for."""

    def __init__(self, cells: DataFrame, ends: DataFrame, pixel: float = 30.0, left: float = 0.0, upper: float = 0.0):
        self.cells, self.ends, self.pixel, self.left, self.upper = cells, ends, pixel, left, upper
        self._line: DataFrame | None = None

    @classmethod
    def create_mndwi(cls, bands: DataFrame, ends: DataFrame, limit: float = 0.01, smallest_hole: int = 64, most_water: float = 0.15, largest: bool = True, **georeference: float) -> River:
        """From bands (scene, row, col, green, swir): the index, its mask, holes filled, cloudy scenes left out, the largest water body kept."""
        value = normalized_difference(F.col("green"), F.col("swir"))
        return cls(mapping.water_of_scenes(bands, value, limit, smallest_hole, most_water, largest), ends, **georeference)

    def _placed(self, df: DataFrame, *keep: str) -> DataFrame:
        x = F.lit(self.left) + (F.col("col") + 0.5) * self.pixel
        y = F.lit(self.upper) - (F.col("row") + 0.5) * self.pixel
        return df.select(*keep, x.alias("x"), y.alias("y"))

    def network(self) -> DataFrame:
        """(scene, u, v, key, seq, x, y)."""
        return self._placed(mapping.networks(self.cells), "scene", "u", "v", "key", "seq")

    def centerline(self) -> DataFrame:
        """(scene, seq, width, x, y), width in ground units. Mapped once and written out: what is asked of it later starts from there."""
        if self._line is None:
            line = mapping.centerlines(self.cells, self.ends).withColumn("width", F.col("half_width") * 2 * self.pixel)
            self._line = checkpointed(self._placed(line, "scene", "seq", "width"))
        return self._line

    def smooth_centerline(self, step: float = 25.0, residual: float = 1e5, least: float = 0.0) -> DataFrame:
        """(scene, seq, x, y): smoothed and resampled, with y downwards from the first row."""
        return mapping.smooth_centerlines(self.cells, self.ends, step, residual, least, self.pixel)

    def belt(self, scene: object, half_width: float) -> DataFrame:
        """(row, col, side): the channel belt of one scene, `half_width` in ground units."""
        line = self.centerline().filter(F.col("scene") == scene)
        line = line.select("seq", ((F.lit(self.upper) - F.col("y")) / self.pixel - 0.5).alias("row"), ((F.col("x") - self.left) / self.pixel - 0.5).alias("col"))
        return belts.belt(self.cells.filter(F.col("scene") == scene), line, half_width / self.pixel)

    def islands(self) -> DataFrame:
        """(scene, row, col, face): land that water encloses, scene by scene, each island named by its first cell."""
        found = None
        for r in self.cells.select("scene").distinct().collect():  # a plan for each scene of the object
            one = self.cells.filter(F.col("scene") == r["scene"]).select("row", "col", F.col("water").alias("line"))
            faces = polygons.faces(one).select(F.lit(r["scene"]).alias("scene"), "row", "col", "face")
            found = faces if found is None else found.unionByName(faces)
        return found

    def water_mask(self, scene: object, buffer: int = 0, fill: int = 1, nodata: int = 0) -> DataFrame:
        """(row, col, water): the mask of one scene as a raster to be written, land grown by `buffer` cells."""
        cells = self.cells.filter(F.col("scene") == scene)
        land = cells.filter("water = 0").select(F.lit(0).alias("node"), "row", "col")
        return polygons.water_mask(cells, land, True, buffer, fill, nodata)

    def banks(self, side: str | None = None) -> DataFrame:
        """(scene, side, x, y) of the left, the right or all banks."""
        b = mapping.banks(self.cells, self.ends)
        return self._placed(b if side is None else b.filter(F.col("side") == side), "scene", "side")

    def widths(self) -> DataFrame:
        """(scene, seq, s, width): along the centerline."""
        return paths.steps(self.centerline()).select("scene", "seq", "s", "width")

    def curvature(self) -> DataFrame:
        return paths.curvature(self.centerline()).select("scene", "seq", "curvature")

    def waves(self, least_sinuosity: float = 1.1) -> DataFrame:
        """Bends between zero crossings of curvature."""
        c = paths.curvature(self.centerline()).withColumn("curvature", F.coalesce("curvature", F.lit(0.0)))
        return paths.waves(c, "curvature", least_sinuosity)

    def change(self, before: Column, after: Column) -> DataFrame:
        """(row, col, kind) between two scenes, each picked by a condition on the cells."""
        from meandra.operators import raster

        water = self.cells.filter("water = 1")
        return raster.change(water.filter(before), water.filter(after))

    def summary(self) -> DataFrame:
        """(scene, vertices, length, mean_width, sinuosity)."""
        c = self.centerline()
        ends = F.sqrt(F.pow(F.max_by("x", "seq") - F.min_by("x", "seq"), F.lit(2)) + F.pow(F.max_by("y", "seq") - F.min_by("y", "seq"), F.lit(2)))
        chord = c.groupBy("scene").agg(F.avg("width").alias("mean_width"), ends.alias("chord"))
        length = paths.lengths(c).select("scene", F.col("n").alias("vertices"), "length")
        return length.join(chord, "scene").select("scene", "vertices", "length", "mean_width", F.try_divide("length", "chord").alias("sinuosity"))

    def pairs(self, catalog: DataFrame, least_days: int = 365, most_days: int = 1826) -> DataFrame:
        """Pairs of scenes of a catalog (river, scene, acq, width) by their gap."""
        return temporal.scene_pairs(catalog, least_days, most_days)
