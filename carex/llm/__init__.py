"""Operators for text corpora and for learned matching. Nothing else in the library imports this subpackage."""
