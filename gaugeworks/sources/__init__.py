"""Readers and writers of project data."""
