"""Operators of a training-data pipeline. One module per operator; ``catalog`` lists the
queries and their DuckDB SQL. Nothing outside this package imports it."""
