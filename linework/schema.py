"""Column layouts of the tables."""

from __future__ import annotations

PIXELS = "image_id long, row long, col long, rgb int"
#: Key of a tile of an image.
TILE = ["image_id", "tile_r", "tile_c"]
