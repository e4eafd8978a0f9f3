"""Readers and writers of annotation documents, label files and rasters."""
