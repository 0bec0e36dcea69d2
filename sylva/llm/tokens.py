"""Tokenising whole texts with the tokenizers library, fast on repeated words.

A byte-level BPE first cuts a text into pieces, and never merges over a cut. A
blank after a character that isn't white space always starts a piece, so a text
can be split there and each chunk encoded by itself: the ids of the text are the
ids of its chunks in order. Chunks repeat, so their ids are kept in a bounded
dictionary for as long as the Python worker lives. New chunks of plain text, those of
a group of texts together, are cut by the tokeniser's pattern, and what is new of their
pieces goes through the tokeniser's model in one call; any other new chunk goes through
the whole tokeniser. (Pieces by themselves are chunks too.)

Added tokens keep the meaning that the tokeniser gives them: a chunk that holds the
content of one goes through the whole tokeniser, and so does a whole text where such a
token has blanks in it or looks at what is around it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode

import numpy as np

_GLUE = re.compile(r"\s ")

#: Chunks and pieces kept by a worker (about 200 bytes each). What isn't seen while
#: half of them come up is forgotten.
CACHE_CHUNKS = 600_000
#: Longer chunks aren't kept.
CACHE_CHARS = 64
#: Texts are encoded together up to about so many characters.
GROUP_CHARS = 1 << 18


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """Split before each blank that follows a character other than white space."""
    parts = text.split(" ")
    if _GLUE.search(text) is None:
        return [parts[0], *[" " + x for x in parts[1:]]]
    out, last, glue = [], parts[0], parts[0][-1:]
    for part in parts[1:]:
        if not glue or glue.isspace():
            last = f"{last} {part}"
        else:
            out.append(last)
            last = f" {part}"
        glue = part[-1:] or " "
    out.append(last)
    return out


# The pattern that cuts text into pieces, for the characters that every
# Unicode version classes alike. It matches nothing of a text with any other.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_O = "!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[{_O}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall
_OTHER = re.compile(rf"[^{_L}{_N}{_O} \t\n\r]").search


class _Known(dict):
    """Ids of chunks and of their pieces, those of a group of texts made at once. What
    starts with its only blank and doesn't end in white space is kept by what follows the
    blank, anything else in ``bare``. Until its ids are made a chunk has a hole, an empty
    byte array."""

    def __init__(self, tokenizer, added: list[str]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.bare: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.older_bare: dict[str, bytes] = {}
        #: holes by what follows the blank, and by chunk
        self.holes: dict[str, bytearray] = {}
        self.bare_holes: dict[str, bytearray] = {}
        #: whether a chunk was asked for that goes on behind the next blank
        self.glued = False
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        #: the tokeniser's model by itself, over pieces with a blank between them
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printed]
        shown = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(other)}
        # the printable character that stands for each byte in the vocabulary; no piece
        # holds byte 0, which parts them
        self.shown = " " + "".join(shown[b] for b in range(1, 256))
        vocab = tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)

    def __missing__(self, rest: str) -> bytes | bytearray:
        if (ids := self.older.get(rest)) is not None:
            self[rest] = ids
            return ids
        if not rest or rest[-1].isspace():
            self.glued = True
            return b""
        self[rest] = self.holes[rest] = hole = bytearray()
        return hole

    def find(self, text: str) -> bytes | bytearray:
        """The ids of a chunk, or its hole."""
        if text.rfind(" ") == 0 and not text[-1].isspace():
            return self[text[1:]]
        if (ids := self.bare.get(text)) is None:
            if (ids := self.older_bare.get(text)) is None:
                ids = self.bare_holes[text] = bytearray()
            self.bare[text] = ids
        return ids

    def age(self) -> None:
        """What isn't seen until the next time is forgotten then."""
        self.older, self.older_bare, self.bare = dict(self), self.bare, {}
        self.clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: one call of the model for all, told apart by the lengths
        of their tokens."""
        raw = "\0".join(pieces).encode()
        shown = charmap_decode(raw, "strict", self.shown)[0]
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
        ends = np.append(gaps, len(raw)) - np.arange(len(gaps) + 1)
        filled = np.cumsum(self.lengths[ids])
        if not len(ids) or filled[-1] != ends[-1]:
            return self._whole(pieces)  # a vocabulary without some byte
        cuts = np.searchsorted(filled, ends)
        if (filled[cuts] != ends).any():
            return self._whole(pieces)
        packed, at = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
        return [packed[i:k] for i, k in zip(at, at[1:])]

    def fill(self) -> None:
        """Make the ids of all holes."""
        holes, self.holes = self.holes, {}
        others, self.bare_holes = self.bare_holes, {}
        text = " " + " ".join(holes)
        if _OTHER(text) or self.added and self.added(text):
            for rest in [x for x in holes if _OTHER(x) or self.added and self.added(" " + x)]:
                others[" " + rest] = holes.pop(rest)
            text = " " + " ".join(holes)
        if holes:
            # each blank starts a chunk, here as in its text
            pieces = _PIECES(text)
            found, new = dict.fromkeys(pieces), []
            kept, older, bare, older_bare = self.get, self.older.get, self.bare.get, self.older_bare.get
            for p in found:
                ids = p[0] == " " and (kept(p[1:]) or older(p[1:])) or bare(p) or older_bare(p)
                if ids:
                    found[p] = ids
                else:
                    new.append(p)
            for p, ids in zip(new, self._pieces(new) if new else ()):
                found[p] = ids
                if len(p) <= CACHE_CHARS:
                    if p[0] == " " and not p[-1].isspace():
                        self[p[1:]] = ids
                    else:
                        self.bare[p] = ids
            parts = [*map(found.__getitem__, pieces)]
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            first = np.array([k for k, p in enumerate(pieces) if p[0] == " "][1:], np.int64)
            packed, cuts = b"".join(parts), ends[first - 1].tolist()
            for (rest, hole), i, k in zip(holes.items(), [0, *cuts], [*cuts, len(packed)], strict=True):
                hole += packed[i:k]
                if len(rest) < CACHE_CHARS:
                    self[rest] = packed[i:k]
                else:
                    del self[rest]
        for (chunk, hole), ids in zip(others.items(), self._whole([*others]) if others else ()):
            hole += ids
            table, key = (self, chunk[1:]) if chunk.rfind(" ") == 0 and not chunk[-1].isspace() else (self.bare, chunk)
            if len(chunk) <= CACHE_CHARS:
                table[key] = ids
            else:
                del table[key]

    def row(self, text: str) -> list[bytes | bytearray]:
        """The ids and holes of a text's chunks."""
        parts = text.split(" ")
        if len(parts) == 1:
            return [self.find(text)]
        head, last = parts[0], parts.pop()
        del parts[0]
        self.glued = head[-1:].isspace()
        out = [*map(self.__getitem__, parts)]
        if self.glued:
            return [self.find(c) for c in chunks(text) if c]
        out.append(self.find(" " + last))
        if head:
            out.insert(0, self.find(head))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that aren't empty."""
        try:
            rows = [self.row(t) for t in texts]
            if self.holes or self.bare_holes:
                self.fill()
        except BaseException:
            # no hole stays behind as if a chunk had no ids
            for table in (self, self.bare, self.holes, self.bare_holes):
                table.clear()
            raise
        return [b"".join(r) for r in rows]


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = spec.get("added_tokens") or []
        #: contents for which a text is not split
        self.unsplit = [a["content"] for a in added if re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"]]
        cut = spec["pre_tokenizer"] or {}
        byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.chunked = bool(byte_level and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        if self.chunked:
            self.kept = _Known(self.tokenizer, [a["content"] for a in added])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        if not self.chunked:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out = [b""] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if text and self.unsplit and any(a in text for a in self.unsplit):
                out[k] = self._whole(text)
            elif text:
                group.append(k)
                size += len(text)
            if size > GROUP_CHARS or k == len(texts) - 1:
                if len(self.kept) + len(self.kept.bare) > self.most // 2:
                    self.kept.age()
                for i, ids in zip(group, self.kept.encode([texts[i] for i in group])):
                    out[i] = ids
                group, size = [], 0
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = CACHE_CHUNKS) -> Encoder:
    """One per Python worker, file and size of what is kept."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
