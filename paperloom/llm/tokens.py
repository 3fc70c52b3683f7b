"""Whole-text encoding with the ``tokenizers`` library, memoised by piece.

Byte-pair merges never cross a pre-token, so a text may be cut wherever the tokenizer's own
pre-tokenizer is bound to cut, each distinct piece encoded once by the library, and the ids
joined.  The cuts used here are coarser than the pre-tokenizer's and are only made where its
pattern cuts in any context:

* GPT-2 style byte level: at every white-space boundary (one leading blank stays with the word)
  and between a run of Latin letters and an ASCII mark;
* lower-casing word patterns that drop white space: at white space and between Latin letters and
  an ASCII mark.

Python's and the library's white space differ at U+001C..U+001F; texts holding those, and every
text of any other tokenizer, are encoded whole.  Equality with whole-text encoding is tested.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .shared import kept

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = r"\s!-/:-@\[-`{-~"
GPT2 = re.compile(rf" ?[{LATIN}]+(?=[{MARK}]|\Z)| ?\S+|\s+(?!\S)|\s+")
WORDS = re.compile(rf"[{LATIN}]+(?=[{MARK}]|\Z)|\S+")
ODD = re.compile("[\x1c-\x1f]")


class PieceEncoder:
    """``encode(text) -> bytes``: the ids as little-endian unsigned 32-bit integers.

    ``cache_size``: distinct pieces remembered per Python worker; further ones are encoded anew.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.room = cache_size
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern, self.folds = self._cuts(spec)

    @staticmethod
    def _cuts(spec: dict):
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return GPT2, False
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        drops = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
        known = split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if drops and known and steps == ["NFC", "Replace", "Lowercase"]:
            return WORDS, True
        return None, False

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _pieces(self, text: str) -> list[str]:
        if self.folds:  # the library lower-cases; within Latin-1 Python does so alike
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, new pieces of all of them encoded in one call."""
        cut = [t and (None if self.pattern is None or ODD.search(t) else self._pieces(t)) for t in texts]
        new = list(set().union(*filter(None, cut)).difference(self.cache))
        found = dict(zip(new, self._whole(new)))
        if len(self.cache) + len(found) <= self.room:
            self.cache.update(found)
            look = self.cache.__getitem__
        else:

            def look(piece, held=self.cache.get, more=found):
                ids = held(piece)
                return more[piece] if ids is None else ids

        return [b"" if not t else self._whole([t])[0] if p is None else b"".join(map(look, p)) for t, p in zip(texts, cut)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def stream(self, rows, text_at: int, most_rows: int = 64, most_chars: int = 1 << 20):
        """(row, ids) of each row of an iterator, encoded some rows at a time."""
        held, load = [], 0
        for row in rows:
            held.append(row)
            load += len(row[text_at] or "")
            if len(held) >= most_rows or load >= most_chars:
                yield from zip(held, self.encode_many([r[text_at] for r in held]))
                held, load = [], 0
        if held:
            yield from zip(held, self.encode_many([r[text_at] for r in held]))


CACHE_SIZE = 600_000


def encoder_of(path: str, cache_size: int = CACHE_SIZE) -> PieceEncoder:
    """This worker process's encoder of a tokenizer; its pieces serve the worker's tasks until another stage keeps something."""
    return kept(("encoder", path, cache_size), lambda: PieceEncoder(path, cache_size))
