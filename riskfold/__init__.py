"""riskfold: outcome-prediction evaluation expressed as Spark DataFrame jobs.

Every stage (column selection, filters, imputation, encoding, scaling,
stratified folds, class balancing, model fits, metrics and curves) is a
keyed DataFrame transformation, so one run covers every
(endpoint, seed, model, fold) combination of a cohort of any size.
"""

from riskfold.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
