"""Thresholds of near-duplicates that the signature can and can't cover."""

import pytest

from buildlens.llm import minhash_dedup


def test_thresholds_that_the_signature_cannot_cover_are_errors():
    for percent in range(1, 101):
        p = percent / 100
        miss = 1 - p**6 - 6 * (1 - p) * p**5
        if miss**32 <= 1e-6:
            assert miss ** minhash_dedup.chunks_for(percent) <= 1e-6
        else:
            with pytest.raises(ValueError, match=f"threshold of {percent} %"):
                minhash_dedup.chunks_for(percent)
    with pytest.raises(ValueError, match="53 chunks"):
        minhash_dedup.chunks_for(60)
