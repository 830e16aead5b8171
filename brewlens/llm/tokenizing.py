"""Whole texts to token ids with a vocabulary file of the ``tokenizers`` library, many documents at a time.

The vocabulary splits at white space and encodes each part alone, so equal parts are encoded once and kept.
Two kinds of text go to the library whole: those with ``<|``, because a special token may stand there, and those with
a combining mark behind a capital of A-Z, because the two may compose only in lower case, which is made early here.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank here changes no id: the pattern ends a run of letters before a symbol anyway (U+0130 ends in a mark in lower case).
_BEFORE_SYMBOL = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([.,!|$%&*#?;:()]+)"
#: A special token may begin here, or a mark follows a capital (lower case first would let the two compose).
_WHOLE = r"<\||[A-Z]\p{M}"


class WordEncoder:
    """``encode(texts)`` gives all ids and the number of ids of each text.

    Right for vocabularies whose pattern drops white space and encodes each white-space separated part alone
    and in lower case. ``keep`` bounds the remembered parts (two generations of so many).
    """

    def __init__(self, file: str, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():  # one run of plain letters: nothing to normalise or split
            ids = [t.id for t in self.model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _known(self, parts: list[str]) -> list[bytes]:
        young, old, out = self.young, self.old, []
        for part in parts:
            ids = young.get(part)
            if ids is None:
                ids = old.get(part)
                if ids is None:
                    ids = self._part(part)
                young[part] = ids
            out.append(ids)
        if len(young) > self.keep:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the counts per text. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), _BEFORE_SYMBOL, r"\1 \2")
        parts = pc.ascii_split_whitespace(plain)
        ends = parts.offsets.to_numpy()
        coded = pc.dictionary_encode(parts.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self._known(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        begin = np.cumsum(size) - size
        long = size[which]
        upto = np.concatenate([[0], np.cumsum(long)])
        ids = pool[np.repeat(begin[which] - upto[:-1], long) + np.arange(upto[-1])]
        marks = upto[ends - ends[0]]
        counts = np.diff(marks)
        if special.any():
            pieces, out = np.split(ids, marks[1:-1]), []
            for i, text in enumerate(texts.to_pylist()):
                out.append(self._whole(text) if special[i] else pieces[i])
            counts = np.array([len(x) for x in out], dtype=np.int64)
            ids = np.concatenate(out) if out else ids
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file, loaded once."""
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text, and the new counts."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
