"""Hash configuration shared by every sketch operator."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# The multiplier that seed 17 gives, and the default word length and sampling rate
# for plain sketches and for linked reads.
DEFAULT_FACTOR = 5273868790340039597
DEFAULT_K = 19
DEFAULT_W = 31
LINKED_READ_K = 21


@dataclass(frozen=True)
class HashSpec:
    """Word length ``k``, sampling rate ``1/w`` and the odd multiplier of the hash.

    The canonical hash of a k-mer lies in ``[0, 4**k)`` and so always fits a signed bigint.
    """

    k: int = DEFAULT_K
    w: int = DEFAULT_W
    factor: int = DEFAULT_FACTOR

    def __post_init__(self):
        if not 1 <= self.k <= 31:
            raise ValueError(f"k must be in 1..31, got {self.k}")
        if self.w < 1:
            raise ValueError(f"w must be positive, got {self.w}")
        if not 0 < self.factor < 1 << 63:
            raise ValueError("factor must be a positive 63-bit integer")

    @property
    def shift(self) -> int:
        return 64 - 2 * self.k

    @property
    def mask(self) -> int:
        return (1 << (2 * self.k)) - 1

    def __str__(self) -> str:
        return f"SH k {self.k}  w {self.w}"

    def compatible(self, other: "HashSpec") -> bool:
        return self == other

    def as_dict(self) -> dict:
        return asdict(self)


SKETCH_SPEC = HashSpec()
LINKED_READ_SPEC = HashSpec(k=LINKED_READ_K)
