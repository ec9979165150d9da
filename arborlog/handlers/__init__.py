"""Shredding files into symbols and putting them back together, by handlers that claim files by their path."""

from arborlog.handlers.router import HANDLERS, handler_of, import_files, render_files, validate_files  # noqa: F401
