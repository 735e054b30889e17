"""Scalar functions as columns: JSON texts, templates, schemas, formats, digests, and a generator for tests."""
