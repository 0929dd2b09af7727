"""corpusflow: corpus and instruction-data curation as Spark DataFrame jobs.

Subpackages
-----------
functions  column expressions (words, shingles, keyed hashes, JSON spans, chat text)
sources    table / JSON-lines / CSV readers, writers and processed-key ledgers
operators  DataFrame -> DataFrame operators (filters, dedup, mixing, encoding, ...)
plans      end-to-end jobs composed from operators, plus the query catalog
streaming  Structured Streaming forms of the incremental jobs
"""

from corpusflow.session import get_session, scratch_root  # noqa: F401

__all__ = ["get_session", "scratch_root"]
