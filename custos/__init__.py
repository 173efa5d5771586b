"""custos: catalogue governance analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (usually a :class:`Catalog`) and returns
a lazy DataFrame. Nothing is collected to the driver; the only driver-side
control flow is the hop loop of the lineage reachability job.
"""

from custos.session import get_spark, ensure_checkpoint_dir
from custos.sources.catalog import Catalog

__all__ = ["Catalog", "get_spark", "ensure_checkpoint_dir"]
