"""Segments of a text that a whitespace-marking BPE model can encode one by one."""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = "▁"
_RUN = re.compile(" +[^ ]*")


def segments(text: str) -> list[str]:
    """The text cut before each run of spaces, each segment without its first space.

    A space is put in front of a text that isn't empty. No piece of the model has a space mark after another
    character, so no merge crosses a cut, and the pieces of the text are those of its segments one after another.
    """
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [x[1:] for x in _RUN.findall(" " + text)]


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """The cut is only right for models in which space marks come first in a piece, with the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    crossing = [p.piece for p in m.pieces if SPACE in p.piece.lstrip(SPACE)]
    spec = m.normalizer_spec
    if crossing or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or any(p.type == 4 for p in m.pieces):
        raise ValueError(f"{path}: segments of this model can't be encoded one by one")
