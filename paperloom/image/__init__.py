"""Pixels to page records: numpy kernels, decoders and pluggable readers."""
