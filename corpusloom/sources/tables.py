"""CSV tables, found inputs and configurations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line ends allowed, a leading BOM dropped; without schema all columns are strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and doubled quotes."""
    df.write.mode(mode).csv(path, header=True, escape='"', quoteAll=True)


def discover(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files below a folder by name pattern, sorted; the listing goes through Spark, so any store will do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return sorted(r[0] for r in found.select("path").collect())


def load_config(path: str, version: int, required: tuple[str, ...] = ()) -> dict:
    """A JSON or YAML configuration of a known version with its required sections; anything else raises."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    if config.get("version", version) != version:
        raise ValueError(f"{path}: version {config.get('version')} is not {version}")
    if missing := [k for k in required if k not in config]:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    return config


def resolve_options(known: dict, *layers: dict | None) -> dict:
    """Options by precedence, the first layer that has one; unknown names raise. `known` has the defaults."""
    for layer in layers:
        if odd := set(layer or ()) - set(known):
            raise ValueError(f"unknown options: {', '.join(sorted(odd))}")
    return {k: next((x[k] for x in layers if x and x.get(k) is not None), default) for k, default in known.items()}
