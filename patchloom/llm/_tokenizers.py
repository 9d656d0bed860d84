"""Whole texts to token ids by the libraries of public tokenizers, loaded once in each worker."""

from __future__ import annotations

import hashlib
import json
from functools import cached_property
from itertools import chain

import numpy as np

from .bpe import _byte_letters

#: The fixed pattern by which byte-level vocabularies of this kind split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces:
    """The bytes of every id, as one flat table."""

    def __init__(self, by_id: dict[int, bytes]):
        size = max(by_id, default=0) + 1
        self.n = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids one after another, where each ends)."""
        n = self.n[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    off = np.cumsum([0, *map(len, lists)])
    return np.fromiter(chain.from_iterable(lists), np.int64, int(off[-1])), off


class ByteLevel:
    """The JSON ``source`` of a byte-level vocabulary. With ``special``, its special tokens count inside texts.

    The ranks of such a file are the order of its ids; where they are not, and for texts whose white space is too
    long for the faster library's pattern, the other library encodes.
    """

    def __init__(self, source: str, special: bool):
        spec = json.loads(source)
        self.source, self.special = source, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters, model = _byte_letters(), spec["model"]
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.pieces = Pieces({i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()})
        self.counted = special
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        self.fast = None
        if made == sorted(made) and all(len(b) == 1 or i >= made[0] for b, i in ranks.items()):
            import tiktoken

            self.fast = tiktoken.Encoding(hashlib.sha256(source.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.source)
        found.no_padding()
        found.no_truncation()
        found.encode_special_tokens = not self.counted
        return found

    def _one(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all") if self.counted else self.fast.encode_ordinary(text)
            except ValueError:
                pass
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        return _joined([self._one(t) for t in texts])


class PieceModel:
    """A model of pieces with byte fallback; it puts a space before each text."""

    def __init__(self, source: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)
        m = self.model
        of = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.pieces = Pieces({i: of(i) for i in range(m.get_piece_size())})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.model.encode(texts, num_threads=1))


_loaded: dict = {}


def loaded(kind, source, *rest):
    """One object of ``kind`` for each source in a worker."""
    key = kind, hash(source), rest
    if key not in _loaded:
        _loaded[key] = kind(source, *rest)
    return _loaded[key]
