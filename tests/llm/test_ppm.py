"""Sorting pairs together with what belongs to them, against plain sorts of codes."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import ppm
from strandline.llm.hashing import text_bytes

SYMBOLS = {"few": 3, "text": 60, "many": 150, "all": 256}


@pytest.mark.parametrize("symbols", SYMBOLS.values(), ids=SYMBOLS)
@pytest.mark.parametrize("sizes", [[0], [1], [0, 4000, 0, 1, 30000, 5]])
def test_pairs_are_sorted_with_their_places_and_training(symbols, sizes):
    rng = np.random.default_rng(symbols + len(sizes))
    data, offsets = rng.choice(rng.permutation(256)[:symbols], sum(sizes)).astype("u1"), np.concatenate([[0], np.cumsum(sizes)])
    code, ends = ppm.pairs(data, offsets)
    plain = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        signs = [ppm.MARK] * ppm.ORDER + data[a:b].tolist() + [ppm.MARK]
        plain += [sum(s << ppm.BITS * (ppm.ORDER - j) for j, s in enumerate(signs[i : i + ppm.ORDER + 1])) for i in range(b - a + 1)]
    assert code.tolist() == plain and ends.tolist() == (offsets + np.arange(len(offsets))).tolist()
    distinct, sizes_, at, ends_ = ppm.places_of_pairs(data, offsets)
    assert [x.tolist() for x in (distinct, sizes_)] == [x.tolist() for x in np.unique(code, return_counts=True)]
    assert (np.repeat(distinct, sizes_) == code[at]).all() and sorted(at.tolist()) == list(range(len(code))) and (ends_ == ends).all()
    trains = rng.random(len(code)) < 0.7
    keys, counts = ppm.pairs_with_training(code, trains)
    assert keys.tolist() == distinct.tolist() and counts.tolist() == [int(trains[code == k].sum()) for k in keys] if len(code) < 99 else counts.sum() == trains.sum()
    assert all((x == y).all() for x, y in zip(ppm.with_training(code, trains), (keys, counts), strict=True))


def test_places_sort_single_numbers(monkeypatch):
    """Places of a text's pairs aren't sorted by their codes, which takes several times as long."""
    monkeypatch.setattr(np, "argsort", None)
    data, offsets = text_bytes(pa.array(["Été, " + "a plain text of some words. " * 1000, "", None]))
    assert len(ppm.places_of_pairs(data, offsets)[2]) == len(data) + 3
