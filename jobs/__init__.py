"""Runnable jobs. Each takes plain paths and a small config file; they build on the library and on nothing of its corpus part."""
