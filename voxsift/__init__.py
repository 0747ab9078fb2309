"""voxsift: review and text analytics as Spark jobs.

Subpackages
-----------
functions   column expressions (text, stemming, vectors, analysis documents)
operators   DataFrame -> DataFrame building blocks (keys, merges, top-k, search)
sources     tables, domain configuration, published search index
plans       whole jobs: extraction, resumable batches, views, topic discovery
streaming   the batch job fed by files that keep arriving
checks      one query per operator over the given tables, with its SQL twin
"""

import sys

from pyspark import cloudpickle

from voxsift.domains import Domain, DomainSet, Extra

# the few Python functions run in tasks travel with the job; executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Domain", "DomainSet", "Extra"]
