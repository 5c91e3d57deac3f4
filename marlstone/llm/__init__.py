"""Training-data operators: one module for each operator, and their queries in ``queries``.

Nothing outside this folder imports it but the guarded import in
``__spark_entry__`` and ``corpus_pipeline``.
"""
