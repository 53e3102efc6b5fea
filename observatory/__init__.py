"""observatory: deterministic analytics over append-only observation histories, on Spark."""
