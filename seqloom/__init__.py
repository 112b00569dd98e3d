"""Spark-first analytics over timed, labelled sequence data."""
