"""Tile paths as column expressions: three templates, read and written.

OSM ``{root}/{z}/{x}/{y}.png``; ZXY ``{root}/{z}/TileExport_{z}_{x}_{y}.png``; XYZ ``{root}/{z}/griddata_{x}_{y}_{z}.png``.
Parsing is strict (whole numbers only, null otherwise); ``digits`` is the lenient reading of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = ("OSM", "ZXY", "XYZ")
#: What the three templates look like; groups are in the order of ORDER.
PATTERNS = {"OSM": r"(?:^|/)(\d+)/(\d+)/(\d+)\.[^./]*$", "ZXY": r"(?:^|/)[^_/]*_(\d+)_(\d+)_(\d+)\.[^./]*$", "XYZ": r"(?:^|/)[^_/]*_(\d+)_(\d+)_(\d+)\.[^./]*$"}
ORDER = {"OSM": "zxy", "ZXY": "zxy", "XYZ": "xyz"}
FORMATS = {"OSM": "%d/%d/%d.png", "ZXY": "%d/TileExport_%d_%d_%d.png", "XYZ": "%d/griddata_%d_%d_%d.png"}


def _known(template: str) -> str:
    if template not in PATTERNS:
        raise ValueError(f"unknown template {template}; use one of {TEMPLATES}")
    return template


def coordinate(path: Column, template: str, axis: str) -> Column:
    """x, y or z of a path; null if the path is not of the template."""
    group = ORDER[_known(template)].index(axis) + 1
    return F.regexp_extract(path, PATTERNS[template], group).try_cast("int")


def parsed(files: DataFrame, template: str = "OSM", least_z: int = 1) -> DataFrame:
    """The catalog of files (path): x, y, z, path of those whose three coordinates parse and z >= least_z."""
    at = {c: coordinate(F.col("path"), template, c).alias(c) for c in "xyz"}
    return files.select(at["x"], at["y"], at["z"], "path").where((F.col("z") >= least_z) & F.col("x").isNotNull() & F.col("y").isNotNull())


def formatted(z: Column, x: Column, y: Column, template: str = "OSM") -> Column:
    """The path of a tile below the root."""
    args = {"OSM": (z, x, y), "ZXY": (z, z, x, y), "XYZ": (z, x, y, z)}[_known(template)]
    return F.format_string(FORMATS[template], *args)


def digits(text: Column) -> Column:
    """The lenient number: characters that are no digits count as 0 in their place; modulo 2^32; empty is 0."""
    return F.aggregate(
        F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.when(c.rlike("^[0-9]$"), c.cast("long")), F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda n, d: (n * 10 + d) % (1 << 32),
    )


def slash(path: Column, nth: int) -> Column:
    """The 0-based place of the nth slash from the end (0: the last); 0 if there is none."""
    parts = F.split(path, "/")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - (nth + 1), F.lit(0)))
    return F.when(F.size(parts) > nth + 1, F.length(F.array_join(kept, "/"))).otherwise(0).cast("int")


def joined(path: Column, component: Column) -> Column:
    """path and component with exactly one slash between them."""
    between = F.when(path.endswith("/") | component.startswith("/"), "").otherwise("/")
    return F.concat(path, between, component)


def folder(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; empty without one."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def target(root: Column, z: Column, x: Column, y: Column, template: str = "OSM") -> Column:
    """Where a tile is written below root."""
    return joined(root, formatted(z, x, y, template))
