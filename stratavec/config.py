"""Validated settings of a retrieval panel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelConfig:
    """Residual codec of `stages` x `codes`, prefix options at `lengths`, and the calibration's depths.

    `train_rows` bounds the rows that codebooks are fitted on; everything else covers all rows.
    """

    seed: int = 17
    stages: int = 4
    codes: int = 16
    lengths: tuple[int, ...] = (1, 2, 3, 4)
    k: int = 10
    hard: int = 10
    rerank: int = 100
    wide: int = 50
    train_rows: int = 4096
    target: int = 2

    def __post_init__(self):
        if self.stages < 1 or self.codes < 2:
            raise ValueError("stages must be at least 1 and codes at least 2")
        if list(self.lengths) != sorted(set(self.lengths)) or self.lengths[0] < 1 or self.lengths[-1] > self.stages:
            raise ValueError("lengths must increase strictly within 1..stages")
        if self.target not in self.lengths:
            raise ValueError("target must be one of lengths")
        if min(self.k, self.hard, self.rerank, self.wide) < 1 or self.rerank < self.k:
            raise ValueError("depths must be positive and rerank at least k")
        if self.train_rows < self.stages * self.codes:
            raise ValueError("train_rows must hold disjoint initial codewords for every stage")

    @property
    def code_bits(self) -> int:
        return max(1, (self.codes - 1).bit_length())

    def cost(self, length: int) -> int:
        """Symbols beyond the shortest prefix."""
        return length - self.lengths[0]


DEFAULT = PanelConfig()
