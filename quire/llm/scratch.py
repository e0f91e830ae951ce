"""Reading tables, and cutting lineage through tables in the folder that the cluster shares."""

from ..scratch import bounded_batches, cut, discard, settled, shared_dir, table

__all__ = ["bounded_batches", "cut", "discard", "settled", "shared_dir", "table"]
