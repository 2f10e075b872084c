"""A worker's memory of what it has already worked out, of bounded size."""

from __future__ import annotations


class Memory:
    """Two generations of answers by key: when the younger is full, the older is forgotten.

    Look-ups go to `young` itself, an ordinary dict; `lack` says first what has to be worked out and put there.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """To be called between pieces of work: makes room if the younger generation is full."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def lack(self, keys: set) -> set:
        """Those keys without an answer. All others are in `young` afterwards."""
        young, old = self.young, self.old
        keys = keys.difference(young)
        back = {k: old[k] for k in keys if k in old}
        young.update(back)
        return keys.difference(back)
