"""How a query is cut into parts for the progressive search: at white space, or into subwords of a given model."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import lru_cache

from .text import normal_string

#: Set to one of these, the variable turns subwords off whatever the options say; any other value turns them on.
SWITCH, OFF = "GLOSSWORK_SUBWORDS", ("0", "false", "False", "no")
MODEL = "GLOSSWORK_SUBWORD_MODEL"


@lru_cache(4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def joined_bytes(pieces: list[str]) -> list[str]:
    """Pieces without the sign for a space before them; runs of byte pieces as the text they spell. Empty ones go."""
    out, raw = [], bytearray()
    for piece in [*pieces, ""]:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            raw.append(int(piece[3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(piece.lstrip("▁"))
    return [x for x in out if x]


def subwords(text: str, path: str) -> list[str]:
    return joined_bytes(_model(path).encode(text, out_type=str))


def tokenizer(use: bool = False, model: str | None = None) -> Callable[[str], list[str]] | None:
    """A function from a query to its normalized parts, or none for white space.

    The environment's switch outweighs `use`, and its model stands in for none given. A model that can't be loaded is
    reported, and white space used.
    """
    if (switch := os.environ.get(SWITCH)) is not None:
        use = switch not in OFF
    path = model or os.environ.get(MODEL)
    if not use:
        return None
    try:
        if not path:
            raise ValueError("no model is given")
        _model(path)
    except Exception as e:
        print(f"glosswork: no subwords ({e}); queries are cut at white space", file=sys.stderr)
        return None
    return lambda text: [normal_string(x) for x in subwords(text or "", path)]
