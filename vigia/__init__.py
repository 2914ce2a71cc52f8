"""vigia — incident-rate and absence-risk analytics on Spark DataFrames.

Subpackages:
    functions  native column expressions (rates, levels, text cleaning, rules)
    sources    readers/writers, sheet-grid promotion, bindings onto the test tables
    operators  DataFrame -> DataFrame operators (rates, cases, features, metrics, models)
    plans      the registered query catalog and its SQL oracles
    streaming  the rate board over a growing file source
"""

from vigia.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
