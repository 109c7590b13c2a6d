"""Recall of embedding near-dedup with many cells, against all pairs."""

import numpy as np
import pytest

from quire.llm import embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def curves(rng, n, width):
    """Points along arcs around centres: partners lie along the arc, not in random directions."""
    centres, out = 40, []
    for _ in range(centres):
        c, u, w = unit(rng.normal(size=(3, width)))
        t = np.sort(rng.uniform(0, 2 * np.pi, n // centres))[:, None]
        out.append(c + np.cos(t) * u + np.sin(t) * w + rng.normal(size=(len(t), width)) * 0.05 / np.sqrt(width))
    return unit(np.concatenate(out))


def topics(rng, n, width):
    """Mixtures of a few topics, with copies at all distances."""
    basis = unit(rng.normal(size=(60, width)))
    x = unit(rng.dirichlet(np.full(60, 0.05), n // 2) @ basis + rng.normal(size=(n // 2, width)) * 0.2 / np.sqrt(width))
    return np.concatenate([x, unit(x + rng.normal(size=x.shape) * rng.uniform(0, 0.33, (len(x), 1)) / np.sqrt(width))])


@pytest.mark.parametrize("width", [64, 256, 768])
@pytest.mark.parametrize("make", [curves, topics])
def test_recall(spark, monkeypatch, make, width):
    rng, n = np.random.default_rng(width), 4000
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", n // 130)
    monkeypatch.setattr(embedding_dedup, "PROBES", 128)
    v = make(rng, n, width)
    rng.shuffle(v)
    linked = v @ v.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(df).collect()}
    want = linked.sum(axis=1)
    assert all(found[k] <= want[k] for k in range(len(v)))  # none below the threshold
    print(make.__name__, width, int(want.sum()), sum(found.values()) / want.sum())
    assert want.sum() > 2000 and sum(found.values()) >= 0.99 * want.sum()
