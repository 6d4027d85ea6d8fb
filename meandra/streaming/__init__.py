"""Streams of scenes."""
