"""Operators that work on any dataset: normalising, unpivoting, counting, ranking, paging."""
