"""Defaults and messages of the library."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

log = logging.getLogger("assaylake")
LEVELS = {"all": logging.INFO, "no_info": logging.WARNING, "error_only": logging.ERROR}


@dataclass
class Settings:
    """``n_jobs`` is the number of shuffle partitions of sessions that are configured here; -1 leaves them alone."""

    n_jobs: int = -1
    debug: bool = False
    figsize: tuple[int, int] = (10, 5)


settings = Settings()


def set_defaults(**changes) -> Settings:
    """Changes the given settings; unknown names are an error, None leaves a setting as it is."""
    names = {f.name for f in fields(Settings)}
    if unknown := set(changes) - names:
        raise ValueError(f"unknown settings {sorted(unknown)}; there are {sorted(names)}")
    for name, value in changes.items():
        if value is not None:
            setattr(settings, name, value)
    return settings


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session."""
    if settings.n_jobs > 0:
        spark.conf.set("spark.sql.shuffle.partitions", str(settings.n_jobs))
    return spark


def set_verbosity_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"level is one of {sorted(LEVELS)}")
    log.setLevel(LEVELS[level])


def warn_overwrite(name: str, existing) -> None:
    if name in existing:
        log.warning("%s is overwritten", name)
