"""Readers and writers for raw records, registries and exports."""
