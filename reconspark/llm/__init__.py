"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
hand its registered queries to ``__spark_entry__``.
"""


def queries():
    from reconspark.llm import registry

    return registry.queries()


def oracle_sql():
    from reconspark.llm import registry

    return registry.oracle_sql()
