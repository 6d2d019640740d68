"""Catalog selection, run loading and file readers/writers."""
