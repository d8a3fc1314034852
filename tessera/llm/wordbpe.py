"""A fast reading of a word-level BPE vocabulary file.

The file's tokenizer removes white space, so the ids of a text are those of its white-space chunks one after
another; chunks repeat, and their ids are kept in a bounded table. A new chunk of plain Latin characters is cut
into words, and each word is merged by a byte-pair core fed with the file's own vocabulary (the end-of-word
suffix is the byte FF, which UTF-8 never has). Any other chunk goes to the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters whose lower-casing and composition are one to one; anything else takes the tokenizer.
PLAIN = re.compile(r"[!-;=-~¡¨-¯´-¸¿-įĲ-ňŊ-ž]+")
LONGEST = 80
#: Entries kept of the chunks and words met first: past this, memory latency costs more than merging anew.
TABLE = 300_000
#: Separators that Python's split and the tokenizer's \s treat differently.
ODD = re.compile("[\x1c-\x1f]")
#: Ids are stored in the machine's order, which is little-endian on every Spark platform in use.
assert sys.byteorder == "little"
MARK = b"\xff"


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """A function from text to its ids as little-endian unsigned 16-bit numbers."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, suffix = byte_letters(), data["model"]["end_of_word_suffix"]
    special = {t["content"] for t in data["added_tokens"]}
    ranks = {}
    for token, number in data["model"]["vocab"].items():
        if token not in special:
            body = token.removesuffix(suffix)
            ranks[bytes(letters[c] for c in body) + (MARK if body != token else b"")] = number
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    exact = Tokenizer.from_file(path)
    words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\sa-zªµºÀ-ÖØ-öø-ſ\d]+")
    odd_numbers = re.compile("[²³¹¼-¾ªµº]")

    def slow(text: str) -> bytes:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            ids = array("H", merge(word.encode() + MARK)).tobytes()
            if len(word) <= LONGEST and len(self) < TABLE:
                self[word] = ids
            return ids

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(chunk) > LONGEST or not PLAIN.fullmatch(chunk) or odd_numbers.search(chunk):
                ids = slow(chunk)
            elif chunk.isalpha():
                ids = pieces[chunk.lower()]
            elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                ids = pieces[chunk[:-1].lower()] + pieces[chunk[-1]]
            else:
                ids = b"".join(map(pieces.__getitem__, words.findall(chunk.lower())))
            if len(chunk) <= LONGEST and len(self) < TABLE:
                self[chunk] = ids
            return ids

    table, pieces = Chunks(), Words()

    def encode(text: str) -> bytes:
        if ODD.search(text):
            return slow(text)
        return b"".join(map(table.__getitem__, text.split()))

    return encode
