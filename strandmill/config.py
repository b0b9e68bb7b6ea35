"""Settings of an index and its searches."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace


def size_in_bytes(text: str) -> int:
    """``64M`` as a number; k, m and g in either case."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([kmgKMG]?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


@dataclass(frozen=True)
class MapConfig:
    """``k``: k-mer length; ``bw``: width of a diagonal bin; ``pf``: least share of supporting k-mers; ``fr``: index
    both strands; ``jaccard``: bins are overlapping fragments of k-mers instead of diagonals; ``compressed``: store
    with the denser codec; ``max_occ``: leave out k-mers with more postings (off by default); ``compat``: literal
    fragment-to-name rule of older releases; ``encoder``: ``dna`` for bases, ``symbols`` for quantised signals of
    ``sigma`` levels, which have one strand. ``sort_blksz`` and ``n_threads`` are kept for files only: Spark sorts
    and schedules by itself."""

    k: int = 15
    bw: int = 15
    pf: float = 0.1
    fr: bool = False
    jaccard: bool = False
    compressed: bool = False
    dynamic: bool = False
    jc_frag_len: int = 180
    jc_frag_ovlp_len: int = 120
    num_shard_bits: int = 10
    n_threads: int = 0
    sort_blksz: str = ""
    sigma: int = 4
    max_occ: int | None = None
    compat: bool = False
    encoder: str = "dna"

    def __post_init__(self):
        if not 1 <= self.k <= 15:
            raise ValueError("k must be from 1 to 15")
        if self.encoder not in ("dna", "symbols"):
            raise ValueError("encoder must be dna or symbols")
        if not 2 <= self.sigma <= 16 or self.encoder == "dna" and self.sigma != 4:
            raise ValueError("sigma must be 4 for bases and from 2 to 16 for symbols")
        if self.sigma**self.k > 1 << 31:
            raise ValueError("k-mers of that many symbols do not fit into 31 bits")
        if self.encoder != "dna" and (self.fr or self.dynamic):
            raise ValueError("signals have no second strand and no dynamic index")
        if self.bw < 1:
            raise ValueError("bw must be positive")
        if not 0 <= self.jc_frag_ovlp_len < self.jc_frag_len:
            raise ValueError("fragments must be longer than their overlap")
        if not 0 <= self.num_shard_bits <= 30:
            raise ValueError("num_shard_bits must be from 0 to 30")
        if self.sort_blksz:
            size_in_bytes(self.sort_blksz)

    @property
    def stride(self) -> int:
        return self.jc_frag_len - self.jc_frag_ovlp_len

    @property
    def fragments(self) -> bool:
        return self.jaccard or self.compressed

    @classmethod
    def of(cls, *flags: str, **values) -> MapConfig:
        """From flags (``"fr"``) and keyword arguments, dashes and underscores alike."""
        known = {f.name for f in fields(cls)}
        given = {f.lstrip("-").replace("-", "_"): True for f in flags} | {k.replace("-", "_"): v for k, v in values.items()}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def with_(self, **values) -> MapConfig:
        return replace(self, **values)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> MapConfig:
        return cls(**json.loads(text))
