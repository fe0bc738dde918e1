"""All queries of the subpackage; importing this registers them."""

from millrace.llm import bpe, compression, decontaminate, jaccard, languages, lines, negatives, sharding, substrings, suffixes, toxicity, urls, whitening  # noqa: F401
from millrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
