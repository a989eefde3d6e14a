"""Network-telemetry analytics on Spark: normalise, window, detect, fuse, learn."""
