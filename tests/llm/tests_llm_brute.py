"""The brute-force versions, for tests that need several of them."""

from test_dedup import brute_components, brute_exact
from test_text import brute_hits

__all__ = ["brute_components", "brute_exact", "brute_hits"]
