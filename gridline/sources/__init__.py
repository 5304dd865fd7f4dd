"""Readers, landing-zone checks, scratch tables and sinks."""
