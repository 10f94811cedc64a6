"""Readers and writers of panels, artifacts and service tables."""
