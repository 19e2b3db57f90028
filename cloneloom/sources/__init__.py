"""Readers of disassembly dumps and graph files."""
