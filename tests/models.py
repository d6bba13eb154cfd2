"""Stand-ins for pretrained models."""

import numpy as np


def quantile_model(repo, device, context, horizon, options):
    """Repeats the last value; a quantile adds its level times the step."""
    steps, levels = np.arange(1, horizon + 1)[:, None], np.array(options["levels"])[None, :]
    return lambda arrays: (np.stack([np.full(horizon, a[-1]) for a in arrays]), np.stack([a[-1] + steps * levels for a in arrays]))


def quantile_model_with_mean(repo, device, context, horizon, options):
    """The same as a list of (points, quantiles with the mean before them)."""
    inner = quantile_model(repo, device, context, horizon, options)

    def call(arrays):
        points, quantiles = inner(arrays)
        return [(p[None, :], np.concatenate([p[:, None], q], axis=1)) for p, q in zip(points, quantiles, strict=True)]

    return call


class Counting:
    """Repeats the last value; writes a file for each array it is asked for, and one when it is freed."""

    def __init__(self, folder):
        self.folder = folder

    def note(self, what):
        import os
        import uuid

        with open(f"{self.folder}/{what}-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

    def __call__(self, arrays):
        for _ in arrays:
            self.note("run")
        return [np.full(3, a[-1]) for a in arrays]

    def __del__(self):
        self.note("freed")


def counting(repo, device, context, horizon, options):
    model = Counting(options["folder"])
    model.note("loaded")
    return model
