"""See the package docstring of :mod:`heronry`."""
