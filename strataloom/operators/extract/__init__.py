"""Symbols, imports, exports, routes and calls of source files."""
