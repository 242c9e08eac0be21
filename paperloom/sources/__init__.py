"""Readers: page images, catalogue and dictionary files, the document index."""
