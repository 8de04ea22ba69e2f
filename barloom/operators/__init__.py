"""Scan-like operators over long bar series: positions, blocks, windows, joins."""
