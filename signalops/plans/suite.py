"""Imports every query module so that the registry is complete."""

from signalops.plans import q_behaviour, q_features, q_inference, q_models, q_quality, q_signal, q_spectral  # noqa: F401
from signalops.plans.registry import ORACLES, QUERIES  # noqa: F401
