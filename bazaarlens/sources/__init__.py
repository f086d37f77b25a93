"""Readers, writers and the adapter from the supplied tables to commerce entities."""
