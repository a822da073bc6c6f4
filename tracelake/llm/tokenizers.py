"""Where the public tokenizers' files are. The path is a parameter of each operator; these are the queries' values."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
