"""Sends this package to the executors, where it is not installed on them."""

from catalens.session import ship

__all__ = ["ship"]
