"""Operators of a training-data pipeline; ``registry`` lists their queries."""
