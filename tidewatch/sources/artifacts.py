"""Fitted things as files: scalers, clips, thresholds and network weights, as JSON that says what it is. Nothing is pickled.

They are small (the size of a network at most) and go through Spark's text reader and writer, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from tidewatch.operators.prep import Scaler

VERSION = 1


def _plain(x):
    if isinstance(x, Scaler):
        return {"kind": "scaler", "centre": x.centre, "scale": x.scale}
    if isinstance(x, np.ndarray):
        return {"kind": "array", "shape": list(x.shape), "values": x.astype(np.float64).ravel().tolist()}
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, dict):
        if not all(isinstance(k, str) for k in x):
            raise TypeError("names are strings")
        return {"kind": "dict", "items": {k: _plain(v) for k, v in x.items()}}
    if isinstance(x, (list, tuple)):
        return {"kind": type(x).__name__, "items": [_plain(v) for v in x]}
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise TypeError(f"{type(x).__name__} isn't something that is saved")


def _made(x):
    if not isinstance(x, dict):
        return x
    kind = x.get("kind")
    if kind == "scaler":
        return Scaler(dict(x["centre"]), dict(x["scale"]))
    if kind == "array":
        return np.array(x["values"], np.float64).reshape(x["shape"])
    if kind == "dict":
        return {k: _made(v) for k, v in x["items"].items()}
    if kind in ("list", "tuple"):
        found = [_made(v) for v in x["items"]]
        return found if kind == "list" else tuple(found)
    raise ValueError(f"unknown kind {kind!r}")


def save(spark: SparkSession, path: str, **things) -> None:
    """Saves named things (scalers, arrays, numbers, texts, and dicts and lists of them), over what was there."""
    text = json.dumps({"version": VERSION, "things": {k: _plain(v) for k, v in things.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict:
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if found.get("version") != VERSION:
        raise ValueError(f"{path} has version {found.get('version')!r}")
    return {k: _made(v) for k, v in found["things"].items()}
