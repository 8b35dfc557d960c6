"""Tolerant phrase search over page-structured text with Spark."""

__version__ = "0.2.0"
__all__ = ["MultipleMatchesError", "Phrase", "SelectionMode", "Session", "highlight_text"]


def __getattr__(name: str):
    if name in __all__:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)
