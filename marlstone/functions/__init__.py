"""See the package docstring of marlstone."""
