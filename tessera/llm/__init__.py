"""Operators for large text corpora and conversation data; nothing else in the library imports this subpackage."""
