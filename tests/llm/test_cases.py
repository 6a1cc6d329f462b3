"""Nulls, empty tables, repeated rows and clashing names for the operators changed last."""

import pytest

from paragrove.llm import neighbours, packing, scannoise, splitting


def test_overlap_of_more_than_half_a_limit_is_refused(spark):
    items = spark.createDataFrame([("a", "x " * 80, "Standard")], "chunk_id string, text string, content_type string")
    for lap, ok in ((20, True), (40, False)):
        limits = spark.createDataFrame([("standard", 60, lap)], "content_type string, max_chars int, overlap_chars int")
        if ok:
            assert splitting.split_oversized(items, limits, order=None).count() > 1
        else:
            with pytest.raises(ValueError):
                splitting.split_oversized(items, limits, order=None)


def test_packing_takes_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, 5, 1, 2), (1, None, 3, 4), (1, 7, 5, 6)], "doc_id bigint, n_tokens bigint, shard int, spot int")
    out = packing.pack(df, 10, shard_rows=1).collect()
    assert len(out) == 3 and sum(r.piece_tokens for r in out) == 12 and [r.container is None for r in out if r.n_tokens == 0] == [True]


def test_noise_of_empty_tables(spark):
    chunks = spark.createDataFrame([(None, "x-\ny"), ("a", None), ("b", "  ")], "chunk_id string, text string")
    figures = spark.createDataFrame([], "figure_key bigint, caption string")
    assert scannoise.noisy(chunks, figures).count() == 0 and scannoise.noisy(chunks.limit(0), figures).count() == 0


def test_lists_in_two_levels_find_what_one_level_finds():
    """The nearest lists of the groups looked into are exact; with all groups they are those of brute force."""
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((90, 16)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    bounds = np.array([0, 30, 30, 60, 90])  # a group without lists
    coarse = np.stack([centres[0:30].mean(0), np.zeros(16), centres[30:60].mean(0), centres[60:90].mean(0)]).astype(np.float32)
    r = rng.standard_normal((200, 16)).astype(np.float32)
    got = neighbours.nearest_lists(r, coarse, centres, bounds, 5, 4)
    assert (got == np.argsort(-(r @ centres.T), axis=1)[:, :5]).all()
    few = neighbours.nearest_lists(r, coarse, centres, np.array([0, 2, 2, 4, 6]), 5, 1)
    assert ((few >= 0).sum(1) <= 2).all() and few.shape == (200, 5)
