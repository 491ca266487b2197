"""Test tables derived from the driver tables, and the DuckDB oracle for each query."""


def load():
    """(queries, oracles) of all query modules."""
    from checks import q_dialogue, q_eval, q_files, q_stream, q_text  # noqa: F401
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
