"""Exact tokenizer ids of whole texts, computed once per distinct word.

Both public vocabularies split a text into pieces before merging. No piece reaches over the last
white-space character of a run (the one right before a word), nor from a letter into a punctuation
mark other than an apostrophe. So texts are cut there, each distinct piece is encoded once by the
tokenizers library, and ids are gathered back with numpy.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

from tidewater.llm.common import byte_view, gather

#: Text to encode at once, in bytes: a longer slice has fewer distinct words to look up for its length.
ENCODE_BYTES = 1 << 22
_PUNCTUATION = [i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "'"]
#: Bytes that surely start no white space: printable ASCII, and lead bytes other than those of Unicode spaces.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x21:0x7F] = True
_WORD[0xC3:0xE1] = True
_WORD[0xE4:0xF5] = True
_LETTER = np.array([chr(i).isalpha() and i < 0x80 for i in range(256)])
_MARK = np.isin(np.arange(256), _PUNCTUATION)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: itself where it can be shown, else from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(i) if i in shown else chr(next(spare)) for i in range(256)]


class WordTokenizer:
    """``encode`` gives the ids that the tokenizer at ``path`` gives for each text, without special tokens."""

    def __init__(self, path: str, cache_size: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        # A lone word of Latin letters is one piece for the merge model; which form it has there depends on the vocabulary.
        self.lower = spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(spec["normalizer"])
        self.spaced = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
        self.letters = _byte_letters()
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _one_word(self, piece: str) -> str | None:
        """The piece as the merge model sees it, if it is a plain word."""
        word = piece[1:] if piece[0] == " " else piece
        if not word.isalpha() or not word.isascii() and max(word) >= "ɐ":
            return None
        if self.lower:
            word = word.lower()
            return "".join([self.letters[b] for b in word.encode()]) if word.isalpha() else None
        return "".join([self.letters[b] for b in (" " + word if piece[0] == " " else word).encode()]) if self.spaced else None

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = [self.young.get(p) for p in pieces]
        rest = []
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = self.old.get(piece)
                if ids is None:
                    word = self._one_word(piece)
                    if word is None:
                        rest.append(i)
                        continue
                    ids = np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()
                found[i] = self.young[piece] = ids
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                found[i] = self.young[pieces[i]] = np.array(e.ids, dtype="<u4").tobytes()
        if len(self.young) > self.cache_size:
            self.old, self.young = self.young, {}
        return found

    def _keep_added_whole(self, cut: np.ndarray, raw: bytes) -> None:
        """The library takes out its added tokens first: no cut inside one, nor in white space before it."""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                cut[max(at - 1, 0) : at + len(token)] = False
                at = raw.find(token, at + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the offset of each text in them; null counts as empty."""
        raw, offsets = byte_view(texts.fill_null(""))
        size = len(raw)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(size + 1, dtype=bool)
        cut[: size - 1] = ((raw[:-1] == 0x20) | (raw[:-1] == 0x0A)) & _WORD[raw[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] = False
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[1:size] |= letter[:-1] & _MARK[raw[1:]]
        if self.added:
            self._keep_added_whole(cut, raw.tobytes())
        cut[offsets] = True
        starts = np.flatnonzero(cut[:size])
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        known = self._ids(pieces.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        first = np.cumsum(lengths) - lengths
        index = pieces.indices.to_numpy()
        counts = lengths[index]
        ids = flat[gather(first[index], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that its words stay known from task to task."""
    return WordTokenizer(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
