"""Models saved in a folder, by name: the loader of `pretrained` for any of them, and one kind that is made here.

A model's folder holds model.json: {"kind": "package.module:Class", ...}. The class is made by
Class.load(folder, settings, device, context_length, horizon, options), with model.json's content as settings. `repo`
is the folder, or a name below options["models"], a folder that every executor can read: any path of
pyarrow's file systems. Loaders named without a package ("name" instead of "module:function") come
from the entry points of the group strandline.models of installed packages.
"""

from __future__ import annotations

import importlib
import importlib.metadata
import io
import json

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = "strandline.models"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str) -> bytes:
    system, at = opened(path)
    with system.open_input_stream(at) as file:
        return file.read()


def write_bytes(path: str, data: bytes) -> None:
    system, at = opened(path)
    system.create_dir(at.rpartition("/")[0])
    with system.open_output_stream(at) as file:
        file.write(data)


def load(repo: str, device: str, context_length: int, horizon: int, options: dict):
    """The model of a folder; options["loader"] = "strandline.forecasters.saved:load" makes `pretrained` use it."""
    folder = f"{options['models'].rstrip('/')}/{repo}" if options.get("models") else repo.rstrip("/")
    try:
        settings = json.loads(read_bytes(f"{folder}/model.json"))
    except FileNotFoundError:
        raise ModuleNotFoundError(f"no model at {folder}") from None
    module, _, name = settings["kind"].partition(":")
    return getattr(importlib.import_module(module), name).load(folder, settings, device, context_length, horizon, options)


def by_name(loader: str):
    """The function of "module:function", or of an entry point's name."""
    if ":" in loader:
        module, _, name = loader.partition(":")
        return getattr(importlib.import_module(module), name)
    for point in importlib.metadata.entry_points(group=GROUP, name=loader):
        return point.load()
    raise ModuleNotFoundError(f"no installed package has a model loader named {loader!r}")


class Linear:
    """A linear map from the last values of a context, less the last one and by their deviation, to the next steps."""

    def __init__(self, weights: np.ndarray, horizon: int | None = None):
        self.weights, self.horizon = weights, horizon or weights.shape[1]

    def __call__(self, arrays):
        x = np.stack([np.asarray(a, "float64")[-(self.weights.shape[0] - 1) :] for a in arrays])
        last, scale = x[:, -1:], np.maximum(x.std(axis=1, keepdims=True), 1e-9)
        made = np.concatenate([(x - last) / scale, np.ones((len(x), 1))], axis=1) @ self.weights
        return list(last + scale * made[:, : self.horizon])

    @classmethod
    def load(cls, folder, settings, device, context_length, horizon, options):
        model = cls(np.load(io.BytesIO(read_bytes(f"{folder}/weights.npy"))), horizon)
        if model.weights.shape[0] - 1 > context_length or model.weights.shape[1] < horizon:
            raise ValueError(f"the model needs {model.weights.shape[0] - 1} values and makes {model.weights.shape[1]} steps, not {context_length} and {horizon}")
        return model

    def save(self, folder: str) -> None:
        data = io.BytesIO()
        np.save(data, self.weights)
        write_bytes(f"{folder}/weights.npy", data.getvalue())
        write_bytes(f"{folder}/model.json", json.dumps({"kind": f"{__name__}:Linear"}).encode())


def fit_linear(examples: DataFrame, window: int, horizon: int, ridge: float = 1.0) -> Linear:
    """The least-squares Linear over all examples (context array<double>, future array<double>).

    Tasks send sums of products, (window + 1) * (window + 1 + horizon) numbers each. Examples with fewer values, or
    with missing ones, don't count.
    """
    width = window + 1

    def sums(batches):
        xx, xy = np.zeros((width, width)), np.zeros((width, horizon))
        for batch in batches:
            for context, future in zip(batch["context"], batch["future"], strict=True):
                if context is None or future is None or len(context) < window or len(future) < horizon:
                    continue
                x, y = np.asarray(context, "float64")[-window:], np.asarray(future, "float64")[:horizon]
                if not (np.isfinite(x).all() and np.isfinite(y).all()):
                    continue
                scale = max(x.std(), 1e-9)
                row = np.append((x - x[-1]) / scale, 1.0)
                xx += np.outer(row, row)
                xy += np.outer(row, (y - x[-1]) / scale)
        import pandas as pd

        yield pd.DataFrame({"at": np.arange(xx.size + xy.size), "s": np.concatenate([xx.ravel(), xy.ravel()])})

    rows = examples.select("context", "future").mapInPandas(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    total = np.array([r.s for r in rows])
    xx, xy = total[: width * width].reshape(width, width), total[width * width :].reshape(width, horizon)
    return Linear(np.linalg.solve(xx + ridge * np.eye(width), xy))
