"""Readers and codecs for frames, topic files and configuration."""
