"""Command line: `python -m swathgrid run config.xml [--set key=value ...]`, `... job order.xml`, `... beams in out`."""

from __future__ import annotations

import argparse
import ast
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import config as cfg
from .catalog import QUALITY_FLAGS
from .operators import neighbours, reconstruct
from .plans import product, regrid
from .plans.watch import Watch
from .sources import beam, swath


def overrides(pairs: list[str]) -> dict:
    """key=value settings; values are Python literals where they can be read as such."""
    out = {}
    for pair in pairs:
        key, _, value = pair.partition("=")
        try:
            out[key] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            out[key] = value
    return out


#: Columns that every run reads, beside the variables asked for.
ALWAYS = ("sample_id", "scan_number", "sample_number", "longitude", "latitude", "processing_scan_angle")


def needed(config: cfg.Config, target: bool = False) -> list[str]:
    """The columns that a run uses of its source bands, or of its target band: the others are not read, and a NULL in them drops nothing."""
    out = [*ALWAYS, *config.variables_to_regrid]
    if config.regridding_algorithm in ("BG", "RSIR", "LW", "CG"):
        if regrid.is_turned(config) or target and regrid.is_target_turned(config):
            out += ["sub_satellite_lon", "sub_satellite_lat"]
        if (config.target_antenna_method if target else config.source_antenna_method) == "instrument":
            out += [*reconstruct.GEOMETRY, "attitude"]
    return list(dict.fromkeys(out))


def run(spark: SparkSession, config: cfg.Config) -> str:
    """Samples under config.path (Parquet, a folder for each band) to a product under config.output_path; its path."""
    grid = (config.grid_definition, config.projection_definition) if config.grid_type == "L1C" else (None, None)
    # counts keep filters from being moved, so each band of several would be read for every other one
    watch = Watch() if config.save_to_disk and len(config.source_band) == 1 else None

    def band(name: str, target: bool = False):
        used = needed(config, target)
        raw = swath.read_l1b(spark, f"{config.path}/{name}", config.type, [*used, "feed_horn_number", *QUALITY_FLAGS])
        out = swath.normalise(raw, config.type, name, *grid, split=config.split_fore_aft, quality=config.quality_control, nedt=config.nedt, needed=used, **({"watch": watch.values} if watch else {}))
        if "sample_id" not in out.columns:
            raise ValueError(f"the samples of band {name} need a sample_id, or scan_number and sample_number")
        return out

    source = band(config.source_band[0])
    for name in config.source_band[1:]:
        source = source.unionByName(band(name), allowMissingColumns=True)
    targets = None
    if config.grid_type == "L1R":
        targets = neighbours.band_targets(band(config.target_band[0], True))
    out = f"{config.output_path}/{product.file_name(config)}"
    made = regrid.regrid(spark, source, config, targets)
    if not config.save_to_disk:  # a trial run: everything is computed, nothing is kept
        made.write.format("noop").mode("overwrite").save()
        return ""
    asked = "regridding_l1b_orphans" in config.variables_to_regrid
    product.write_product(made, out, config, orphans=regrid.orphan_flags(spark, source, config, targets) if asked else None, watch=watch)
    return out


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="swathgrid", description=__doc__)
    parser.add_argument("what", choices=("run", "job", "beams"))
    parser.add_argument("path", help="the config, the job order, or the folder of beam files")
    parser.add_argument("out", nargs="?", help="where beam patterns go")
    parser.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE", help="settings that win over the config's")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("swathgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    more = overrides(a.set)
    if a.what == "beams":
        beam.preprocess(spark, a.path, a.out, **more)
    elif a.what == "job":
        order = Path(a.path).read_text(encoding="utf-8")
        named = Path(cfg.parse_job_order(order)["config"]).read_text(encoding="utf-8")
        print(run(spark, cfg.job_config(order, named).with_overrides(**more)))
    else:
        print(run(spark, cfg.read_xml(a.path, **more)))


if __name__ == "__main__":
    main(sys.argv[1:])
