"""orrery — Spark-native engine for many-series price indicators, arrival-year
probability scenarios and return forecasts.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
transformation keyed by ``symbol`` (price series) or ``scenario_id``
(probability scenarios).  Nothing is collected to the driver in the middle of
a job; ordered-series work is laid out in bounded row blocks so that a single
very long series is spread over many tasks (see ``orrery.plans.sequence``).
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
