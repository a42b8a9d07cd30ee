"""The library's logger: Python's own, silent unless a level is asked for."""

from __future__ import annotations

import logging

_LOGGER = logging.getLogger("logweave")
_LOGGER.addHandler(logging.NullHandler())


def logger() -> logging.Logger:
    return _LOGGER


def set_level(level: str = "", debug: bool = False) -> logging.Logger:
    """debug, info, warn, error or none; debug mode wins over the level. A name that isn't known counts as info."""
    known = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR, "none": logging.CRITICAL + 1}
    _LOGGER.setLevel(logging.DEBUG if debug else known.get(level.lower(), logging.INFO))
    return _LOGGER
