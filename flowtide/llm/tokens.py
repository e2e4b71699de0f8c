"""Token ids of whole texts by the ``tokenizers`` library, through a word memo.

The tokenizer folds case, drops white space and never joins characters across
it, nor a letter with a following stop, so the ids of a text are the ids of its
words in turn.  Each distinct word is encoded
by the library once per worker and then looked up by hash; the memo is a set of
sorted arrays of bounded size that is emptied when full.  White space inside a
"word" here (other than 0x20, 0x09-0x0D) and special tokens are left to the library.
"""

from __future__ import annotations

import os

import numpy as np

from .textnum import lower_ascii, word_hashes, words

#: Stands between words that are encoded together: a digit is a token run of its own.
_MARK = "٠"


class WordEncoder:
    def __init__(self, path: str, memo_words: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo_words = memo_words
        self.mark = self._plain([_MARK])[0]
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, found: list[str]) -> list[np.ndarray]:
        """Ids of each word; words are sent in joined runs, parted by the mark."""
        out: list[np.ndarray] = []
        s, k = self.mark, len(self.mark)
        for lo in range(0, len(found), 512):
            run = found[lo : lo + 512]
            joined = f" {_MARK} ".join(run)
            parts = None
            if joined.count(_MARK) == len(run) - 1:
                ids = np.array(self._plain([joined])[0], np.uint32)
                hit = np.ones(max(0, len(ids) - k + 1), bool)
                for j in range(k):
                    hit &= ids[j : len(ids) - k + 1 + j] == s[j]
                cuts = np.flatnonzero(hit)
                if len(cuts) == len(run) - 1:
                    parts = [ids[a:b] for a, b in zip([0, *(cuts + k)], [*cuts, len(ids)])]
            out += parts if parts is not None else [np.array(x, np.uint32) for x in self._plain(run)]
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's range in them."""
        if b"<|" not in (raw := buf.tobytes()):  # else a special token's spelling matters
            buf = lower_ascii(buf)
            raw = buf.tobytes()
        starts, ends, rows = words(buf, offs, stops=True)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        keys, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.memo_words:
            self._empty()
        near = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            f = first[new]
            ids = self._encode([raw[a:b].decode() for a, b in zip(starts[f].tolist(), ends[f].tolist())])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            where = np.searchsorted(self.keys, keys[new])
            self.at = np.insert(self.at, where, len(self.pool) + np.cumsum(n) - n)
            self.len = np.insert(self.len, where, n)
            self.keys = np.insert(self.keys, where, keys[new])
            self.pool = np.concatenate([self.pool, *ids])
        slot = np.searchsorted(self.keys, keys)[which]
        n = self.len[slot]
        upto = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(self.at[slot] - upto[:-1], n) + np.arange(upto[-1])
        return self.pool[take], upto[rows]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
