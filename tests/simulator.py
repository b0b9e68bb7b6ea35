"""Voting read by read and vote by vote, in plain Python, to hold the plans against."""

from __future__ import annotations

import numpy as np


def code(b: int) -> int:
    return (b >> 1) & 3


def kmers(raw: bytes, k: int) -> list[int]:
    out = []
    for i in range(len(raw) - k + 1):
        v = 0
        for b in raw[i : i + k]:
            v = v * 4 + code(b)
        out.append(v)
    return out


def revcomp(raw: bytes) -> bytes:
    return bytes("TGAC"[code(b)].encode()[0] for b in reversed(raw))


class Counter:
    def __init__(self):
        self.n, self.top, self.most = {}, None, 0

    def vote(self, key):
        seen = self.n.get(key, 0)
        self.n[key] = seen + 1
        if seen > self.most:
            self.most, self.top = seen, key


class Simulator:
    def __init__(self, refs: list[tuple[str, bytes]], k=15, bw=15, pf=0.1, frag=None):
        self.k, self.bw, self.pf, self.frag = k, bw, np.float32(pf), frag
        self.names = [n for n, _ in refs]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for r, (_, seq) in enumerate(refs):
            codes = kmers(seq, k)
            if frag:
                length, stride = frag
                for f, start in enumerate(range(0, len(codes), stride)):
                    for v in codes[start : start + length]:
                        self.index.setdefault(v, []).append((r, f))
            else:
                for p, v in enumerate(codes):
                    self.index.setdefault(v, []).append((r, p))
        for hits in self.index.values():
            hits.sort()

    def one(self, raw: bytes):
        c, codes = Counter(), kmers(raw, self.k)
        for j, v in enumerate(codes):
            for r, p in self.index.get(v, ()):
                if self.frag:
                    c.vote((r, p))
                    continue
                b = max(p - j, 0) // self.bw
                c.vote((r, b))
                if b >= self.bw:
                    c.vote((r, b - self.bw))
        if c.top is None:
            return "*", 0, np.float32(0)
        support = np.float32(c.most / len(codes))
        if support < self.pf:
            return "*", 0, np.float32(0)
        return self.names[c.top[0]], c.top[1] * (self.frag[1] if self.frag else self.bw), support

    def search(self, raw: bytes, both=True):
        if len(raw) <= 2 * self.k:
            return "*", True, 0, np.float32(0)
        a = self.one(raw)
        if not both:
            return a[0], True, *a[1:]
        b = self.one(revcomp(raw))
        return (a[0], True, *a[1:]) if a[2] >= b[2] else (b[0], False, *b[1:])
