"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Tokens are runs of letters and digits, lower-cased. A token's input is its own vector beside the mean of the vectors
of its character n-grams (3 to 5, with edge marks), both hashed, and the log odds with which the token and its
n-grams stand in toxic documents. Two gated recurrences run over a window of tokens,
one in each direction; attention weighs their states, and the pooled state gives the window's logit. All windows of
``WIDTH`` tokens at every ``STEP`` tokens are scored, up to the end of the text; a document's score is a calibrated
logistic function of its largest and its third largest window logit and of the number of windows.

Labels are of documents, not of windows, so training alternates: windows of toxic documents with the largest logits
are taken as toxic, those of other documents (the largest and random ones) as not toxic, and the network is fitted
to them; the first choice goes by log odds. So that the network trusts log odds no more than unseen texts allow, a
training document's are counted in the other folds, learned vectors are left out at random, and one fold is kept for
calibration alone.

Fitting takes one text and the highest label of an id, at most ``per_class`` labelled documents with
label 1 and as many with label 0, those that come first
in a seeded hash order, and of those the texts of at most ``longest`` bytes, so that what the driver gets is bounded;
that sample is the only part that doesn't see all rows. Scoring is one pass over
whole texts without a shuffle; inputs of known tokens are kept per worker, up to a bound.

Defined results: null and empty texts, and others without tokens, score 0; any length of text is taken whole; null labels
are left out; without two labels to learn from every score is the label's share (0.5 without any); a null ``doc_id``
counts as the text "null" for the held-out rule; repeated rows stay; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, STEP = 24, 12
WORDS, GRAMS, GRAM_SIZES, SIZE, HIDDEN = 1 << 14, 1 << 15, (3, 4, 5), 12, 12
#: Tokens whose inputs a worker keeps, and windows that it scores at once.
REMEMBER, AT_ONCE = 150_000, 4096
BATCH = 192

_token = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    return _token.findall(text.lower()) if text else []


class Inputs:
    """Hashed places of a list of tokens' own vectors and of their n-grams' vectors; place 0 is left for no token.

    The n-grams of all tokens are hashed at once, as polynomials over the tokens' bytes with an edge mark on either
    side; those that would cross an edge are left out.
    """

    def __init__(self, tokens: list[str]):
        raw = [b"<" + t.encode("utf-8", "replace") + b">" for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        whole = np.array([zlib.crc32(r) for r in raw], np.int64)
        self.word = 1 + whole % (WORDS - 1)
        found = []
        for n in GRAM_SIZES:
            if len(byte) < n:
                continue
            h = np.full(len(byte) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(1099511628211) ^ byte[k : len(byte) - n + 1 + k]
            h ^= h >> np.uint64(29)
            own = owner[: len(h)] == owner[n - 1 :]
            found.append((owner[: len(h)][own], (1 + h[own] % np.uint64(GRAMS - 1)).astype(np.int32)))
        of = np.concatenate([o for o, _ in found]) if found else np.zeros(0, np.int32)
        gram = np.concatenate([g for _, g in found]) if found else np.zeros(0, np.int32)
        self.gram = gram[np.argsort(of, kind="stable")]
        self.start = np.r_[0, np.cumsum(np.bincount(of, minlength=len(raw)))]

    def odds_of(self, which: np.ndarray, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log odds of some tokens, and the mean and largest of their n-grams' log odds."""
        out = np.zeros((len(which), 3), "f4")
        out[:, 0] = odds[0][self.word[which]]
        grams, row = self.grams_of(which)
        if len(grams):
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            value = odds[1][grams]
            out[row[begin], 1] = np.add.reduceat(value, begin) / np.diff(np.r_[begin, len(grams)])
            out[row[begin], 2] = np.maximum.reduceat(value, begin)
        return out

    def grams_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some tokens and the row in ``which`` of each."""
        n = self.start[which + 1] - self.start[which]
        row = np.repeat(np.arange(len(which)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[which][row]
        return self.gram[at], row


def windows(n: int) -> list[int]:
    """Where the windows over ``n`` tokens begin; the last one ends with the text."""
    return [*range(0, n - WIDTH, STEP), n - WIDTH] if n > WIDTH else [0]


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        m = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        self.p = {
            "word": (0.1 * r.standard_normal((WORDS, SIZE))).astype("f4"), "gram": (0.1 * r.standard_normal((GRAMS, SIZE))).astype("f4"),
            "in": m(2 * SIZE + 3, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, "f4"), "back": m(HIDDEN, 3 * HIDDEN), "ahead": m(HIDDEN, 3 * HIDDEN),
            "look": m(2 * HIDDEN, 1)[:, 0], "out": m(2 * HIDDEN, 1)[:, 0], "base": np.zeros(1, "f4"),
        }
        self.odds = np.zeros(WORDS, "f4"), np.zeros(GRAMS, "f4")
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])

    def vectors(self, inputs: Inputs, which: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams, row = inputs.grams_of(which)
        n = np.maximum(1, inputs.start[which + 1] - inputs.start[which])
        total = np.zeros((len(which), SIZE), "f4")
        if len(grams):
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[begin]] = np.add.reduceat(self.p["gram"][grams], begin, axis=0)
        return np.hstack([self.p["word"][inputs.word[which]], total / n[:, None], odds]).astype("f4"), grams, row, n

    def project(self, inputs: Inputs, which: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """What the gates of both directions get from each token."""
        parts = [which[a : a + at_once] for a in range(0, len(which), at_once)] or [which]
        return np.vstack([self.vectors(inputs, w, inputs.odds_of(w, self.odds))[0] @ self.p["in"] + self.p["bias"] for w in parts])

    def _run(self, g: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, batch, hidden) of one direction; ``g`` (time, batch, gates)."""
        h = np.zeros((g.shape[1], HIDDEN), "f4")
        out = np.empty((g.shape[0], g.shape[1], HIDDEN), "f4")
        k = HIDDEN
        for t in range(len(g)):
            a = h @ u
            zr = _sig(g[t, :, : 2 * k] + a[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(g[t, :, 2 * k :] + r * a[:, 2 * k :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * k :]))
            h = np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``g`` (time, batch, both directions' gates), ``mask`` true where there is a token."""
        k3, ahead, back = 3 * HIDDEN, [] if keep is not None else None, [] if keep is not None else None
        f = self._run(g[:, :, :k3], mask, self.p["ahead"], ahead)
        b = self._run(g[::-1, :, k3:], mask[::-1], self.p["back"], back)[::-1]
        h = np.concatenate([f, b], axis=2)
        e = np.where(mask, h @ self.p["look"], np.float32(-30))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tb,tbk->bk", alpha, h)
        if keep is not None:
            keep.update(ahead=ahead, back=back, h=h, alpha=alpha, pooled=pooled, mask=mask)
        return pooled @ self.p["out"] + self.p["base"][0]

    def _run_back(self, d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        d_g, d_u, d_h = np.zeros((*d_out.shape[:2], 3 * HIDDEN), "f4"), np.zeros_like(u), np.zeros(d_out.shape[1:], "f4")
        for t in range(len(d_out) - 1, -1, -1):
            h, z, r, n, a_n = kept[t]
            d_h = d_h + d_out[t]
            m = mask[t][:, None]
            new = d_h * m
            d_n = new * (1 - z) * (1 - n * n)
            d_z = new * (h - n) * z * (1 - z)
            d_r = d_n * a_n * r * (1 - r)
            d_g[t] = np.hstack([d_z, d_r, d_n])
            d_a = np.hstack([d_z, d_r, d_n * r])
            d_u += h.T @ d_a
            d_h = d_h * ~m + new * z + d_a @ u.T
        return d_g, d_u

    def gradients(self, inputs: Inputs, odds: np.ndarray, fold: np.ndarray, tok: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.random.Generator | None) -> tuple[float, dict]:
        """Mean weighted log loss of windows of tokens (batch, time), and its gradients; those of vectors by place.
        ``odds`` by fold and token; ``drop`` leaves out learned vectors of half the tokens."""
        both, at = np.unique(tok * len(odds) + fold[:, None], return_inverse=True)
        which, at = both // len(odds), at.reshape(tok.shape)
        vec, grams, row, n = self.vectors(inputs, which, odds[both % len(odds), which])
        left = np.ones((len(which), 1), "f4") if drop is None else 2 * drop.integers(0, 2, (len(which), 1)).astype("f4")
        vec[:, : 2 * SIZE] *= left
        keep: dict = {}
        logit = self.forward((vec @ self.p["in"] + self.p["bias"])[at.T], mask.T, keep)
        p = _sig(logit)
        loss = -float(np.mean(weight * np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        d = (weight * (p - y) / len(y)).astype("f4")
        h, alpha = keep["h"], keep["alpha"]
        d_pool = d[:, None] * self.p["out"]
        d_alpha = np.einsum("bk,tbk->tb", d_pool, h)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0)) * keep["mask"]
        d_h = alpha[:, :, None] * d_pool[None] + d_e[:, :, None] * self.p["look"]
        g = {"out": keep["pooled"].T @ d, "base": d.sum(keepdims=True), "look": np.einsum("tb,tbk->k", d_e, h)}
        d_f, g["ahead"] = self._run_back(d_h[:, :, :HIDDEN], keep["mask"], self.p["ahead"], keep["ahead"])
        d_b, g["back"] = self._run_back(d_h[::-1, :, HIDDEN:], keep["mask"][::-1], self.p["back"], keep["back"])
        d_gate = np.concatenate([d_f, d_b[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        order = np.argsort(at.T.ravel(), kind="stable")
        begin = np.searchsorted(at.T.ravel()[order], np.arange(len(which)))
        by_token = np.add.reduceat(d_gate[order], begin, axis=0)
        g["in"], g["bias"] = vec.T @ by_token, by_token.sum(0)
        d_vec = by_token @ self.p["in"][: 2 * SIZE].T * left
        g["word"] = (inputs.word[which], d_vec[:, :SIZE])
        g["gram"] = (grams, (d_vec[:, SIZE:] / n[:, None])[row])
        return loss, g


class _Steps:
    """Adam for full matrices, Adagrad for single vectors."""

    def __init__(self, net: Network, rate: float = 0.01, vector_rate: float = 0.05):
        self.net, self.rate, self.vector_rate, self.n = net, rate, vector_rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.p.items()}

    def take(self, g: dict) -> None:
        self.n += 1
        for k, v in g.items():
            if isinstance(v, tuple):
                total = np.stack([np.bincount(v[0], d, len(self.net.p[k])) for d in v[1].T], 1)
                place = np.flatnonzero(total.any(1))
                total = total[place].astype("f4")
                self.square[k][place] += total**2
                self.net.p[k][place] -= self.vector_rate * total / (np.sqrt(self.square[k][place]) + 1e-6)
            else:
                self.mean[k] = 0.9 * self.mean[k] + 0.1 * v
                self.square[k] = 0.99 * self.square[k] + 0.01 * v * v
                self.net.p[k] -= (self.rate * (self.mean[k] / (1 - 0.9**self.n)) / (np.sqrt(self.square[k] / (1 - 0.99**self.n)) + 1e-7)).astype("f4")


def summary(logits: np.ndarray) -> np.ndarray:
    """What a document's score is made of, from its windows' logits."""
    top = np.sort(logits)[::-1]
    return np.array([1.0, top[0], top[min(2, len(top) - 1)], np.log(len(top))])


def log_odds(seen: np.ndarray, share: float, prior: float = 3.0) -> np.ndarray:
    """From documents without (row 0) and with (row 1) the label that hold each place: how much it raises the odds."""
    p = (seen[1] + prior * share) / (seen.sum(0) + prior)
    return np.log(p / (1 - p) / (share / (1 - share))).astype("f4")


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 5, folds: int = 5, seed: int = 10) -> Network:
    """A network fitted to texts with labels 0 and 1, both present; the last fold is for calibration."""
    r = np.random.default_rng(seed)
    net = Network(seed)
    index: dict[str, int] = {}
    flat = []  # tokens become numbers text by text, so that their strings are kept once
    for text in texts:
        tokens = tokens_of(text)
        flat.append(np.fromiter((index.setdefault(t, len(index)) for t in tokens), np.int32, len(tokens)))
    names = list(index)
    inputs = Inputs(names)
    del index
    empty = len(names)  # stands where a window has no token
    inputs.word, inputs.start = np.r_[inputs.word, 0], np.r_[inputs.start, inputs.start[-1]]
    fold = np.empty(len(flat), np.int64)
    for y in (0, 1):  # each label is dealt evenly
        own = r.permutation(np.flatnonzero(labels == y))
        fold[own] = np.arange(len(own)) % folds
    last = folds - 1
    words, grams = np.zeros((folds, 2, WORDS)), np.zeros((folds, 2, GRAMS))
    for ids, y, f in zip(flat, labels, fold):
        if len(ids):
            words[f, y, np.unique(inputs.word[ids])] += 1
            grams[f, y, np.unique(inputs.grams_of(np.unique(ids))[0])] += 1
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    every = np.array_split(np.arange(len(names) + 1), len(names) // 20_000 + 1)
    odds = np.empty((folds, len(names) + 1, 3), "f4")  # those of the last fold, counted in all others, are the network's own
    for f in range(folds):
        used = [k for k in range(last) if k != f] or [0]
        net.odds = log_odds(words[used].sum(0), share), log_odds(grams[used].sum(0), share)
        for w in every:
            odds[f, w] = inputs.odds_of(w, net.odds)

    n_windows = np.array([len(windows(len(ids))) for ids in flat])
    first = np.r_[0, np.cumsum(n_windows)]
    doc = np.repeat(np.arange(len(flat)), n_windows)
    tok = np.full((len(doc), WIDTH), empty, np.int32)
    for i, ids in enumerate(flat):
        for k, s in enumerate(windows(len(ids))):
            part = ids[s : s + WIDTH]
            tok[first[i] + k, : len(part)] = part
    mask = tok != empty
    at_fold = fold[doc]
    logits = np.where(mask, odds[at_fold[:, None], tok, 0], -9).max(1)  # the first choice of windows
    steps, table = _Steps(net), np.empty((len(names) + 1, 6 * HIDDEN), "f4")
    for _ in range(rounds):
        pos, neg = [], []
        for i in np.flatnonzero(fold != last):
            own = np.arange(first[i], first[i + 1])
            best = own[np.argsort(-logits[own])]
            if labels[i]:
                pos += best[: max(1, min(3, len(best) // 8))].tolist()
            else:
                neg += [*best[:2].tolist(), *r.choice(own, min(3, len(own)), replace=False).tolist()]
        ids = np.array(pos + neg)
        y = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        weight = np.where(y == 1, len(y) / (2 * max(1, len(pos))), len(y) / (2 * max(1, len(neg))))
        for _ in range(2):
            for part in np.array_split(r.permutation(len(ids)), max(1, len(ids) // BATCH)):
                k = ids[part]
                _, g = net.gradients(inputs, odds, at_fold[k], tok[k], mask[k], y[part], weight[part], r)
                steps.take(g)
        logits = np.empty(len(tok))
        for f in range(folds):
            for w in every:
                table[w] = net.vectors(inputs, w, odds[f, w])[0] @ net.p["in"] + net.p["bias"]
            own = np.flatnonzero(at_fold == f)
            for k in np.array_split(own, len(own) // AT_ONCE + 1):
                logits[k] = net.forward(table[tok[k].T], mask[k].T)
    kept = np.flatnonzero(fold == last)
    x = np.array([summary(logits[first[i] : first[i + 1]]) for i in kept])
    net.calibration = _logistic(x, labels[kept].astype(float))
    return net


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sig(x @ w)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


class Scorer:
    """Scores whole texts; keeps the gate inputs of tokens it has met."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.table = np.empty((REMEMBER + 1, 6 * HIDDEN), "f4")
        self.table[0] = net.project(_no_token(), np.zeros(1, np.int64))[0]

    def _rows(self, docs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of each document's tokens in a table of gate inputs."""
        new = list({t for d in docs for t in d if t not in self.index})
        if len(self.index) + len(new) > REMEMBER:
            self.index.clear()
            new = list({t for d in docs for t in d})
        table = self.table
        if len(new) > REMEMBER:  # a batch that is larger than what is kept
            index = {t: i + 1 for i, t in enumerate(new)}
            table = np.vstack([self.table[:1], self.net.project(Inputs(new), np.arange(len(new)))])
        else:
            index, n = self.index, len(self.index)
            if new:
                table[n + 1 : n + 1 + len(new)] = self.net.project(Inputs(new), np.arange(len(new)))
                index.update((t, n + 1 + i) for i, t in enumerate(new))
        return [np.fromiter(map(index.__getitem__, d), np.int64, len(d)) for d in docs], table

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A score per text; one without tokens has nothing toxic in it and scores 0."""
        rows, table = self._rows([tokens_of(t) for t in texts])
        tok, n_windows = [], []
        for ids in rows:
            if len(ids) < WIDTH:
                ids = np.r_[ids, np.zeros(WIDTH - len(ids), np.int64)]
            starts = np.array(windows(len(ids)))
            tok.append(ids[starts[:, None] + np.arange(WIDTH)])
            n_windows.append(len(starts))
        tok = np.concatenate(tok)
        logits = np.concatenate([self.net.forward(table[t.T], t.T > 0) for t in (tok[a : a + AT_ONCE] for a in range(0, len(tok), AT_ONCE))])
        x = np.array([summary(part) for part in np.split(logits, np.cumsum(n_windows)[:-1])])
        return _sig(x @ self.net.calibration) * np.array([len(ids) > 0 for ids in rows])


def _no_token() -> Inputs:
    none = Inputs([])
    none.word, none.start = np.zeros(1, np.int64), np.zeros(2, np.int64)
    return none


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 2500, seed: int = 10, longest: int = 1 << 17) -> Network | float:
    """The network, or the share of label 1 where there are no two labels to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # two ordered limits, so that no task gets a whole label
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    some = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a broadcast of 2 * per_class rows of two numbers at most
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("one"))
    one = one.select("doc_id", "one.text", "one.y").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    pdf = one.toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    if pdf["y"].nunique() < 2:
        return float(pdf["y"].mean()) if len(pdf) else 0.5
    return train(pdf["text"].tolist(), pdf["y"].to_numpy(np.int64), seed=seed)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Network | float, at_once: int = 256) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the corpus

    def run(batches):
        scorer = Scorer(shared.value) if isinstance(shared.value, Network) else None
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                texts = part.column(1).to_pylist()
                s = scorer.scores(texts) if scorer else np.full(len(texts), shared.value)
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
