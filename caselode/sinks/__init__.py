"""Writing results: case tables, safe CSV, manifests, exports."""
