"""Composed plans: registered queries, model fits, search and evaluation."""

import importlib

_MODULES = ("q_prepare", "q_split", "q_metrics", "q_models", "q_explain")


def load_all():
    """Import every query module (registration happens on import); a missing
    module is an error."""
    for mod in _MODULES:
        importlib.import_module(f"riskfold.plans.{mod}")
    from riskfold.plans.registry import REGISTRY
    return REGISTRY
