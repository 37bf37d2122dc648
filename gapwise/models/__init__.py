"""Learners, certain-model checks and iterative cleaning on top of Spark aggregates."""
