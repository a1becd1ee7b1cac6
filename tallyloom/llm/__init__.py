"""Operators for training-data pipelines, each built by one fixed method; ``queries`` registers them."""
