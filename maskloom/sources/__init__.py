"""Readers and writers for capture records, image files and region tables."""
