"""Importing the package registers the builders of every record kind."""

from siftline.operators import (  # noqa: F401
    browsers, esxi, files, linux, live, macos, records, registry, sections, windows,
)
