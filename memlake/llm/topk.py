"""The best rows of many keys, kept in bounded memory while a task's rows go by."""

from __future__ import annotations

import numpy as np

#: Stands for a null id: behind all others among equal scores.
NULL_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


class Best:
    """The first ``k`` (score, id) of each of ``keys`` keys: highest scores, then smallest ids.

    ``floor[key]`` is the score below which a row can't be among them any more. Rows that are
    equal in score and id each count.
    """

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, LOWEST)
        self.key = self.score = self.id = np.empty(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        able = score >= self.floor[key]
        if not able.any():
            return
        key, score, ids = (np.concatenate([old, new[able]]) for old, new in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        stay = place < self.k
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]
        last = place[stay] == self.k - 1
        self.floor[self.key[last]] = self.score[last]
