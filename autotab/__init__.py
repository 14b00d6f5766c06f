"""autotab: automatic tabular modelling expressed as Spark DataFrame / SQL / ML jobs.

Layout:
  functions/  column-expression helpers (keys, cleaning, probabilities) and
              distributed building blocks (ranks, prefix sums, exact quantiles,
              size-checked lookups)
  sources/    readers for CSV/parquet inputs, derived modelling tables, sinks
  operators/  profiling, labels, feature transforms, splits, metrics, models,
              search, calibration, ensembles, explanations, holdout scoring
  plans/      configuration, model registry, automatic training plan
  streaming/  incremental scoring with Structured Streaming
"""

__version__ = "0.1.0"
