"""Size of the Arrow batches that texts travel in, as for all readers."""

from ..functions.batches import ROWS, small_batches

__all__ = ["ROWS", "small_batches"]
