"""Spark ML layer: model factory, training, tuning, ensembles, registry, model-based selection."""
