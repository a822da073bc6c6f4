"""Byte-level BPE ids, each text's by the tokenizers library: whole texts, no special tokens added.

Of what the library offers the batch call without offsets is used, which gives the same ids. Its threads stay off, since
tasks are parallel already.

Most of the library's time goes into cutting a text into words: each becomes a string with alignments of its own. Merges
work within words only, so words between which no merge of the file can reach may stay together and come out as
the same ids. `coarse` is the library with such cuts: up to WORDS words in a row stay one piece where each begins with a
space, or where two printable ASCII characters other than the apostrophe meet. What any other place cuts, and every
match that does not begin so, is the file's own rule. That no merge reaches over those places is read off the file's
merges, and in each batch a text chosen by hash is encoded with the file's own cuts as well. A file with other
settings, or with such merges, is used as it is.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array

#: Characters of texts that are encoded in one call of the library (one text at least), and words that stay one piece.
CALL_CHARACTERS, WORDS = 30_000, 16

#: What the library's ByteLevel cuts by, and one of its words without its space, whole, if no apostrophe is in it.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = r"(?>\p{L}+|\p{N}+|(?>[^\s\p{L}\p{N}']+)(?!'))"
CUTS = rf"(?> ?{WORD}(?> {WORD}|(?<=[!-~])(?=[!-&(-~]){WORD}){{0,{WORDS - 1}}})|{RULE}"

#: In the byte alphabet: a space after what may end a word (ASCII white space and U+00A0 may not), and two kinds of ASCII side by side.
_MARKS = r"!-&(-/:-@\[-`{-~"
REACHES_OVER = re.compile(rf"[^ĠĉĊċČč](?<!Âł)Ġ|[A-Za-z][0-9{_MARKS}]|[0-9][A-Za-z{_MARKS}]|[{_MARKS}][A-Za-z0-9]")

_loaded: dict[str, ByteBpe] = {}


def worker_bpe(path: str) -> ByteBpe:
    """One tokenizer for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def may_stay_together(file: dict) -> bool:
    """Whether `CUTS` gives the ids that the tokenizer file's own cuts give."""
    own, model = file["pre_tokenizer"] or {}, file["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if file["normalizer"] or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True) or model.get("type") != "BPE" or not plain:
        return False
    return not any(REACHES_OVER.search("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"])


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are written as this machine's unsigned ints, which must be little-endian and 32 bits wide")
        self.library = Tokenizer.from_file(path)
        self.coarse = self.library
        with open(path, encoding="utf-8") as f:
            if may_stay_together(json.load(f)):
                from tokenizers import Regex, pre_tokenizers

                self.coarse = Tokenizer.from_file(path)
                bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
                self.coarse.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(CUTS), "isolated"), bytes_only])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= CALL_CHARACTERS:
                size += len(texts[stop])
                stop += 1
            out += [array("I", e.ids).tobytes() for e in self.coarse.encode_batch_fast(texts[at:stop], add_special_tokens=False)]
            at = stop
        if texts and self.coarse is not self.library:
            k = zlib.crc32(texts[0].encode()) % len(texts)
            if array("I", self.library.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids).tobytes() != out[k]:
                raise RuntimeError(f"the file's own cuts give other ids for {texts[k][:200]!r}")
        return out
