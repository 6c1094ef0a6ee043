"""Scans, sinks and fixture adapters."""
