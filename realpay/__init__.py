"""realpay: purchasing-power salary analytics on Spark DataFrames.

Every public operator takes and returns a ``DataFrame``; column names are
arguments. Most are purely lazy; quantile, fence and size-check steps run
small jobs when called and pass at most a few numbers per group through the
driver. No Python UDF runs in any plan: all work is expressed with
``pyspark.sql.functions`` so it stays inside Catalyst and whole-stage code
generation.

Layout
------
``realpay.session``     session settings (ANSI, UTC, AQE, checkpoint dir)
``realpay.sources``     table loading, CSV with NA tokens, test fixtures
``realpay.functions``   column expressions (roundings, strict numbers, clamps, PPP)
``realpay.operators``   profiling, exact quantiles, IQR, correlation, grouping,
                        trends, dimension join
``realpay.plans``       the composed reports and the query catalog
``realpay.streaming``   intentionally empty (the analysed report is batch only)
"""

__version__ = "0.1.0"
