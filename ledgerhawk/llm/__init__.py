"""Training-data operators.  Nothing outside this folder and the pipeline
imports it; ``load()`` gives its queries and their oracle SQL."""


def load():
    from . import queries
    return queries.QUERIES, queries.ORACLE
