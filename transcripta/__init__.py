"""transcripta: gene-expression analytics as Spark DataFrame operators.

Every public function takes Spark DataFrames (long format, keyed by gene and
sample) and returns a lazy DataFrame.  Nothing is collected except scalars
(counts, block numbers, a picked power) and matrices whose size is bounded by
a parameter (K x K signature moments, S x S sample Gram for PCA).
"""

__version__ = "0.1.0"
