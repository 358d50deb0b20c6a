"""Readers, sinks and configuration."""
