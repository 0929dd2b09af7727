"""Readers, writers and processed-key ledgers."""
