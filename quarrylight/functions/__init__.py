"""Part of quarrylight; see the package docstring."""
