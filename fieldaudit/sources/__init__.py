"""Readers, writers, and the tables the named queries run on."""
