"""Structured Streaming forms of the incremental jobs (ST1-ST3).

Every job is ``readStream`` -> ``foreachBatch`` with a checkpoint; each
micro-batch writes its outputs to ``.../batch=<id>`` folders with overwrite,
so a batch replayed after a failure replaces its own partial output.
"""
