"""merchgrid subpackage."""
