"""Settings of the derived index: defaults, then a TOML file, then the session's configuration.

The file has one table, ``[index]``; the session's keys are ``spark.nearfield.index.<name>``.  A
value that can't be read, or isn't allowed, leaves the one before it in force.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.nearfield.index."
_PATH = os.path.join(os.path.expanduser("~"), ".nearfield", "config.toml")


def set_config_path(path: str | os.PathLike) -> None:
    global _PATH
    _PATH = os.fspath(path)


def config_path() -> str:
    return _PATH


@dataclass(frozen=True)
class Settings:
    #: Rows without an index from which on one is built, or brought up to date, by an append.
    index_min_rows: int = 65_536
    #: Inputs up to which appends keep an index by themselves: with many inputs a cell's radius is as
    #: large as the distances between cells, and one pass over all rows is cheaper.
    index_max_dim: int = 12
    #: Rows that a cell of the index should hold.
    index_cell_rows: int = 4_096
    #: Ratio by which the scale of a search may differ from the index's, input against input.
    index_stretch: float = 4.0
    #: Cells that a search reads for a query; None searches exactly.
    index_budget: int | None = None

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        given: dict[str, object] = {}
        try:
            with open(_PATH, "rb") as f:
                table = tomllib.load(f).get("index", {})
        except (OSError, tomllib.TOMLDecodeError):
            table = {}
        for f in fields(cls):
            name = f.name.removeprefix("index_")
            told = [table.get(name)] if isinstance(table, dict) else []
            told.append(spark.conf.get(PREFIX + name, None) if spark is not None else None)
            kind = float if name == "stretch" else int
            for v in told:
                try:
                    value = kind(v) if v is not None and not isinstance(v, bool) else None
                except (TypeError, ValueError):
                    continue
                if value is not None and value >= 1:
                    given[f.name] = value
        return cls(**given)


def ensure_config_file() -> str:
    """Write the defaults where there is no file yet; the file's path."""
    if not os.path.exists(_PATH):
        os.makedirs(os.path.dirname(_PATH) or ".", exist_ok=True)
        lines = [f"{f.name.removeprefix('index_')} = {f.default}" for f in fields(Settings) if f.default is not None]
        with open(_PATH, "w") as out:
            out.write("\n".join(["[index]", *lines, ""]))
    return _PATH
