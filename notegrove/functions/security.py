"""Paths that stay inside a vault, guarded reads and embeds, file URIs, packed vectors."""

from __future__ import annotations

import os
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MAX_BYTES

#: Embeds are opened up to this depth.
EMBED_DEPTH = 5


class OutsideVault(ValueError):
    pass


def within_vault(root: str, path: str) -> str:
    """The real path of a relative one, links followed. A path that is absolute, climbs out, or leads out by a link is refused."""
    steps: list[str] = []
    if "\x00" in path or path.startswith(("/", "\\")) or path[1:2] == ":":
        raise OutsideVault(path)
    for part in path.replace("\\", "/").split("/"):
        if part == ".." and not steps:
            raise OutsideVault(path)
        if part == "..":
            steps.pop()
        elif part not in ("", "."):
            steps.append(part)
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(top, *steps))
    if os.path.commonpath([top, full]) != top:
        raise OutsideVault(path)
    return full


def read_note(root: str, path: str) -> str:
    """The text of one file of a vault, MAX_BYTES at most."""
    full = within_vault(root, path)
    if os.path.getsize(full) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    with open(full, encoding="utf-8") as f:
        return f.read()


def embedded_text(name: str, contents: dict[str, str], embeds, seen: tuple[str, ...] = ()) -> str:
    """A note's text with the notes that it embeds in their places. embeds(text) gives start, end and name of each. A note within
    itself, or deeper than EMBED_DEPTH, becomes a comment; an unknown name stays as it is written."""
    if name in seen:
        return f"<!-- embed cycle: {name} -->"
    if len(seen) > EMBED_DEPTH:
        return f"<!-- embed too deep: {name} -->"
    text, out, at = contents[name], [], 0
    for start, end, inner in embeds(text):
        if inner in contents:
            out += [text[at:start], embedded_text(inner, contents, embeds, (*seen, name))]
            at = end
    return "".join([*out, text[at:]])


def uri_of(path: str) -> str:
    return "file://" + quote(path)


def path_of(uri: str) -> str:
    return unquote(uri.removeprefix("file://"))


@F.pandas_udf(T.BinaryType())
def packed_vector(v: pd.Series) -> pd.Series:
    """An array of numbers as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_vector(b: pd.Series) -> pd.Series:
    """The floats of packed_vector; bytes that aren't whole floats are an error."""

    def one(x):
        if x is None:
            return None
        if len(x) % 4:
            raise ValueError(f"{len(x)} bytes are no 32-bit floats")
        return np.frombuffer(x, "<f4").tolist()

    return b.map(one)
