"""Ready-made queries over the benchmark tables, with matching SQL."""
