"""Detectors: each is a fire predicate and a result struct over one feature row."""

from wiretally.operators.detectors.base import Detector, Verdict
from wiretally.operators.detectors.mesh import (
    DETECTORS, detect, detector_states, kinds_of, needed_features, rule_detectors,
)

__all__ = ["DETECTORS", "Detector", "Verdict", "detect", "detector_states", "kinds_of", "needed_features", "rule_detectors"]
