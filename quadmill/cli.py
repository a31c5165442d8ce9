"""Command line: one zoom level of PNG tiles to the next one out (default) or in.

    python -m quadmill.cli IN OUT [-reprocess] [-inOSM|-inZXY|-inXYZ] [-outOSM|-outZXY|-outXYZ] [-interpXX] [-zIn|-zOut]

XX: AV (average), L3, L5 (Lanczos), NN, BI (bilinear), EX (EPX), EA (Eagle), XB (XBR).  Options match by their beginning;
the last of a kind counts.  Out, the default is L3; in, EX.  -reprocess also writes the source tiles again, smaller, below
OUT; sources are never deleted unless -delete is given too, and then only after all is written.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quadmill.operators import paths, tiles
from quadmill.sources import png_tree

#: The codes of -interp.
METHODS = {"AV": "average", "L3": "lanczos3", "L5": "lanczos5", "NN": "nearest", "BI": "bilinear", "EX": "epx", "EA": "eagle", "XB": "xbr"}


@dataclass
class Options:
    source: str = ""
    target: str = ""
    read: str = "OSM"
    write: str = "OSM"
    method: str | None = None
    inward: bool = False
    reprocess: bool = False
    delete: bool = False
    help: bool = False


def options(arguments: list[str]) -> Options:
    o, plain = Options(), []
    for a in arguments:
        if a.startswith("-help"):
            o.help = True
        elif a.startswith("-reprocess"):
            o.reprocess = True
        elif a.startswith("-delete"):
            o.delete = True
        elif a.startswith("-interp"):
            if a[7:9] not in METHODS:
                raise ValueError(f"unknown method {a}")
            o.method = METHODS[a[7:9]]
        elif a[:3] in ("-zI", "-zO"):
            o.inward = a[2] == "I"
        elif a.startswith("-in") or a.startswith("-out"):
            rest = a[3:] if a.startswith("-in") else a[4:]
            found = [t for t in paths.TEMPLATES if rest and t.startswith(rest[0])]
            if not found:
                raise ValueError(f"unknown template {a}")
            if a.startswith("-in"):
                o.read = found[0]
            else:
                o.write = found[0]
        elif a.startswith("-"):
            raise ValueError(f"unknown option {a}")
        else:
            plain.append(a)
    if not o.help:
        if len(plain) != 2:
            raise ValueError("an input and an output path are needed")
        o.source, o.target = plain
    return o


def execute(spark: SparkSession, o: Options) -> DataFrame:
    """Runs one step and gives the tiles that it wrote."""
    files = png_tree.catalog(spark, o.source, o.read, 0 if o.inward else 1)
    if files.isEmpty():
        raise ValueError(f"no tiles found below {o.source}")
    source = png_tree.read_tiles(spark, o.source, o.read, 0 if o.inward else 1)
    if o.reprocess:
        source = source.persist()  # decoded once for both sinks
    out = tiles.enlarge(source, 1, o.method or "epx") if o.inward else tiles.downsample(source, o.method or "lanczos3")
    png_tree.write_tiles(out, o.target, o.write)
    if o.reprocess:
        png_tree.write_tiles(source, o.target, o.write)
        if o.delete:
            decoded = source.select("z", "x", "y").join(files, ["z", "x", "y"])
            new = paths.formatted(decoded["z"], decoded["x"], decoded["y"], o.write)
            png_tree.remove(spark, [r[0] for r in decoded.where(~decoded["path"].endswith(new)).select("path").toLocalIterator()])
        source.unpersist()
    return out


def main(arguments: list[str] | None = None) -> int:
    try:
        o = options(sys.argv[1:] if arguments is None else arguments)
    except ValueError as e:
        print(e, __doc__, sep="\n\n", file=sys.stderr)
        return 2
    if o.help:
        print(__doc__)
        return 0
    execute(SparkSession.builder.appName("quadmill").getOrCreate(), o)
    return 0


if __name__ == "__main__":
    sys.exit(main())
