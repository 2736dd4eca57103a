"""Mixing takes its share of long and of short documents alike."""

import numpy as np

from lamella.llm import mixing


def test_share_does_not_depend_on_length():
    rng = np.random.default_rng(11)
    for share in (0.2, 0.5, 0.81):
        sizes, counts = np.unique(np.clip(rng.lognormal(5.3, 1.1, size=500).astype(np.int64), 1, 20_000), return_counts=True)
        budget = int(share * (sizes * counts).sum())
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and budget - int((take * sizes).sum()) in (0, 1)
        rank = np.cumsum(counts)
        for part in (rank <= 250, (rank > 250) & (rank <= 450), rank > 450):
            assert abs(take[part].sum() / counts[part].sum() - share) < 0.06
