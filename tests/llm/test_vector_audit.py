"""One large group does not hide links that are missing elsewhere."""

import numpy as np
import pytest

from disarm.llm import vector_dedup

PAIRS, GROUP = 300, 300


@pytest.fixture
def frame(spark):
    """A group of near copies, and pairs at a cosine of 0.955."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    group = unit(rng.standard_normal(32)) + 0.01 * rng.standard_normal((GROUP, 32))
    left = unit(rng.standard_normal((PAIRS, 32)))
    noise = rng.standard_normal((PAIRS, 32))
    noise = unit(noise - (noise * left).sum(axis=1, keepdims=True) * left)
    rows = np.concatenate([group, left, 0.955 * left + np.sqrt(1 - 0.955**2) * noise])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")


def test_too_few_orders_are_an_error(frame, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ORDERS", 1)
    monkeypatch.setattr(vector_dedup, "REACH", 1)
    monkeypatch.setattr(vector_dedup, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="audited recall"):
        vector_dedup.near_copies(frame).collect()


def test_orders_follow_until_pairs_are_found(frame, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ORDERS", 4)
    monkeypatch.setattr(vector_dedup, "REACH", 4)
    got = {r.vec_id: r for r in vector_dedup.near_copies(frame).collect()}
    assert all(got[i].n_links == GROUP - 1 for i in range(GROUP))
    met = sum(got[GROUP + i].n_links > 0 for i in range(PAIRS))
    assert met >= 0.97 * PAIRS and got[0].audited_recall >= 0.99
