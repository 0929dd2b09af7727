"""Training-data pipeline operators; nothing else in the library imports this subpackage.

Each operator has its own module and interface; ``queries`` registers one
``opN_<name>`` query per operator over the driver tables, and the repository's
``corpus_pipeline`` chains five of them.
"""
