"""See the package docstring in stacklight/__init__.py."""
