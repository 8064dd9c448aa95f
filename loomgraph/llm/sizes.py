"""Token sizes of texts by the public tokenizers' own libraries, in Arrow batches within tasks."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

#: Fixed value: the pattern by which the byte-level vocabularies cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE given by a rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def size(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def ends(self, text: str) -> np.ndarray:
        """Offset in bytes after each token."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int32)])


#: Cuts a text with a blank before it where pieces of most models end anyway: before blanks, around digits and control characters, and between
#: letters and marks of ASCII (a carriage return goes with these). Whether that holds for a model is looked up in its pieces.
_ONE, _MARKS = r"\x00-\x0c\x0e-\x1f0-9\x7f", r"\r!-/:-@\[-`{-~"
_RUN, _REST = f"(?:[A-Za-z]+|[{_MARKS}]+)", rf"[^\x00-\x7f][^ {_ONE}]*"
WORD = re.compile(f" +{_RUN}?(?:{_REST})?|{_RUN}(?:{_REST})?|{_REST}|[{_ONE}]")


class _Words(dict):
    """Lengths in bytes of the tokens of a word, as bytes of numbers of 16 bits. The longest words aren't held, and no more than ``HELD`` are: what isn't held is encoded again."""

    HELD, LONGEST = 131_072, 64

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        # the model puts a blank before a text; where the word has none, a line's end keeps them apart, and both are taken off
        ids, own = (self.pieces.model.encode(word[1:]), 0) if word[0] == " " else (self.pieces.model.encode("\n" + word), 2)
        lengths = b"\1\0" if word == " " else self.pieces.lengths[np.array(ids, np.int32)].astype("<u2")[own:].tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.HELD:
                self.clear()
            self[word] = lengths
        return lengths


class Pieces:
    """A piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.lengths = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).replace("▁", " ").encode()) for i in range(n)], np.int32)
        # where each piece lies within a word, no merge goes over the end of one, and each word is encoded once
        normal = (self.model.id_to_piece(i).replace("▁", " ") for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))
        self.by_words = all(WORD.fullmatch(x) for x in normal) and self.model.encode("\n", out_type=str) == ["▁", "<0x0A>"] and self.model.encode(" ", out_type=str) in (["▁▁"], ["▁", "▁"])
        self.words = _Words(self)

    def size(self, text: str) -> int:
        return len(self.model.encode(text))

    def ends(self, text: str) -> np.ndarray:
        """Offset in bytes after each token; the blank put before the text takes no place."""
        whole = len(text.encode())
        if self.by_words and text:
            ends = np.cumsum(np.frombuffer(b"".join(map(self.words.__getitem__, WORD.findall(" " + text))), "<u2"), dtype=np.int64)
            if len(ends) and ends[-1] == whole + 1:
                return np.maximum(ends - 1, 0)
        ids = self.model.encode(text)
        ends = np.cumsum(self.lengths[np.array(ids, np.int32)])
        if len(ends) and ends[-1] != whole + 1:  # the model has changed some characters: ask it where its pieces come from
            ends = np.array([len(text[: p.end].encode()) for p in self.model.encode(text, out_type="immutable_proto").pieces])
            return np.minimum(ends, whole)
        return np.maximum(ends - 1, 0)


@functools.lru_cache(maxsize=8)
def tokenizer(folder: str, name: str) -> ByteLevel | Pieces:
    """The tokenizer of that name (see the README of the folder), once for each Python worker."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.exists(path):
        return ByteLevel(path)
    path = os.path.join(folder, f"{name}.model")
    if os.path.exists(path):
        return Pieces(path)
    raise ValueError(f"no rank file or piece model {name} in {folder}")
