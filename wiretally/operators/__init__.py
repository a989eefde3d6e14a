"""DataFrame-to-DataFrame operators: windows, detectors, fusion, drift, evaluation."""
