"""A small causal self-attention network over subword ids, in numpy: overlapping windows, batched masked attention, its gradient.

The network tells classes of ids (Goodman's factored output): P(id | context) = P(class | context) * P(id | class, id before).
The first factor is a softmax over counted class frequencies after the id before, times what one attention layer over the
window says; the second factor is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

STRIDE, OVERLAP = 24, 8       # a window scores STRIDE ids, each after OVERLAP earlier ones of the text at least, where there are so many
WIDTH = STRIDE + OVERLAP
SIZE, HIDDEN = 16, 24
CLASSES = 48
OWN_ROWS, SHARED_ROWS = 2048, 128   # embeddings: the most frequent ids have one each, the rest share
BATCH = 128                   # windows of a training step
RATE = 0.02
SEED = 13

_KEYS = np.arange(WIDTH)
_BACK = np.arange(STRIDE)[:, None] + OVERLAP - _KEYS          # how far a key lies behind a query
_NEVER = np.where(_BACK < 0, np.float32(-1e9), np.float32(0))
_OPENING = (_KEYS >= OVERLAP).astype(np.float32)              # a text's first window has nothing before it
_BACK = np.maximum(_BACK, 0)
LIMIT = np.float32(20)        # scores are cut off there, so no exponential overflows
TINY = np.float32(1e-30)
PAIRS = 1 << 22               # pairs of ids that are kept at most: those seen at least once in so many
BACK = np.float32(4)          # weight of the coarser estimate in each counted one


@dataclass
class Windows:
    """Places of ``keys`` (windows x WIDTH) and ``targets`` (windows x STRIDE) in the ids; ``real`` says which targets are in the text."""

    keys: np.ndarray
    targets: np.ndarray
    real: np.ndarray
    opening: np.ndarray
    doc: np.ndarray

    def __getitem__(self, pick) -> Windows:
        return Windows(self.keys[pick], self.targets[pick], self.real[pick], self.opening[pick], self.doc[pick])


def windows(bounds: np.ndarray, pick=None) -> Windows:
    """Windows of texts that lie one after the other, each an end id and its own ids; ``bounds`` split them. Every id but the leading one is a target once.

    ``pick`` (doc, number) -> bool chooses windows before they are laid out.
    """
    n = np.diff(bounds) - 1
    count = -(-n // STRIDE)
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    if pick is not None:
        chosen = pick(doc, number)
        doc, number = doc[chosen], number[chosen]
    begin = bounds[:-1][doc] + number * STRIDE
    last = bounds[1:][doc] - 1
    targets = begin[:, None] + np.arange(1, STRIDE + 1)
    keys = np.clip(begin[:, None] + _KEYS - OVERLAP, 0, last[:, None])
    return Windows(keys, np.minimum(targets, last[:, None]), targets <= last[:, None], number == 0, doc)


SHAPES = {"embed": (OWN_ROWS + SHARED_ROWS, SIZE), "query": (SIZE, SIZE), "key": (SIZE, SIZE), "value": (SIZE, SIZE), "behind": (WIDTH,),
          "into": (2 * SIZE, HIDDEN), "into_bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "out_bias": (CLASSES,)}
LENGTH = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters of one flat vector, by name."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh(seed: int = SEED) -> np.ndarray:
    """Starting weights; the output layer is zero, so the counted table speaks alone before training."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(LENGTH, np.float32)
    for name, view in views(flat).items():
        if view.ndim == 2 and name != "out":
            view[:] = rng.normal(0, 1.0 if name == "embed" else view.shape[0] ** -0.5, view.shape)
    return flat


@dataclass
class Vocabulary:
    """What is counted: the class and the embedding row of every id, P(class | row of the id before), P(id | class, class before),
    and how often the frequent ``pairs`` (row before * ids + id, sorted) were seen, with their sum for each row and class."""

    class_of: np.ndarray
    row_of: np.ndarray
    after_row: np.ndarray      # rows x CLASSES
    in_class: np.ndarray       # CLASSES x ids
    pairs: np.ndarray
    seen: np.ndarray
    seen_class: np.ndarray     # rows x CLASSES

    def within(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | its class, the id before)."""
        c, row = self.class_of[target], self.row_of[before]
        coarse = self.in_class[self.class_of[before], target]
        key = row.astype(np.int64) * len(self.class_of) + target
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1) if len(self.pairs) else None
        own = np.where(self.pairs[place] == key, self.seen[place], np.float32(0)) if place is not None else np.float32(0)
        return np.log((own + BACK * coarse) / (self.seen_class[row, c] + BACK))


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, row) of every id: classes cut the ids by falling count into equal shares of all counts plus one each."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    weight = counts[order] + 1.0
    share = (np.cumsum(weight) - weight / 2) / weight.sum()
    class_of, row_of = np.empty(len(counts), np.int32), np.empty(len(counts), np.int32)
    # Shares skip numbers where one id holds several; the classes that are used are numbered without gaps.
    class_of[order] = np.unique(np.minimum(share * CLASSES, CLASSES - 1).astype(np.int32), return_inverse=True)[1]
    place = np.arange(len(counts))
    row_of[order] = np.where(place < OWN_ROWS, place, OWN_ROWS + place % SHARED_ROWS)
    return class_of, row_of


def vocabulary(counts: np.ndarray, row_then_class: np.ndarray, class_then_id: np.ndarray, pairs: np.ndarray, seen: np.ndarray) -> Vocabulary:
    """From counts of ids, of (row before, class), of (class before, id) and of frequent (row before, id). All estimates fall back on the coarser one, and no id has probability zero."""
    class_of, row_of = classes(counts)
    by_class = np.bincount(class_of, counts + 1.0, CLASSES)
    plain = by_class / by_class.sum()
    after = (row_then_class + BACK * plain) / (row_then_class.sum(axis=1, keepdims=True) + BACK)
    own = (counts + 1.0) / by_class[class_of]
    total = np.zeros((CLASSES, CLASSES))
    for c in range(CLASSES):
        total[c] = np.bincount(class_of, class_then_id[c], CLASSES)
    inside = (class_then_id + BACK * own) / (total[:, class_of] + BACK)
    # Rows that several ids share tell nothing about a single pair.
    single = pairs // len(counts) < OWN_ROWS
    pairs, seen = pairs[single], seen[single]
    by = np.argsort(pairs)
    pairs, seen = pairs[by], seen[by]
    place = pairs // len(counts) * CLASSES + class_of[pairs % len(counts)]
    sums = np.bincount(place, seen, after.size).reshape(after.shape)
    return Vocabulary(class_of, row_of, after.astype(np.float32), inside.astype(np.float32), pairs, seen.astype(np.float32), sums.astype(np.float32))


def _rows(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _attend(p: dict[str, np.ndarray], q: np.ndarray, k: np.ndarray, v: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unscaled weights, weighted sums of v); a last column of ones in v gives the sums of the weights."""
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    a += p["behind"][_BACK] + _NEVER
    np.clip(a, -1e9, LIMIT, out=a)
    np.exp(a, out=a)
    a[opening] *= _OPENING
    y = a @ v
    y[:, :, SIZE] += TINY
    return a, y


def _say(p: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    out = h @ p["out"]
    out += p["out_bias"]
    return np.clip(out, -LIMIT, LIMIT, out=out)


def forward(p: dict[str, np.ndarray], x: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What the network says of the classes (windows x STRIDE x CLASSES), from embedding rows (windows x WIDTH)."""
    n = len(x)
    e = p["embed"][x]
    last = np.ascontiguousarray(e[:, OVERLAP:])
    both = _rows(e) @ np.concatenate([p["key"], p["value"]], axis=1)
    k, v = both[:, :SIZE].reshape(n, WIDTH, SIZE), np.ones((n, WIDTH, SIZE + 1), np.float32)
    v[:, :, :SIZE] = both[:, SIZE:].reshape(n, WIDTH, SIZE)
    q = (_rows(last) @ (p["query"] * np.float32(SIZE**-0.5))).reshape(n, STRIDE, SIZE)
    a, y = _attend(p, q, k, v, opening)
    z = np.concatenate([last, y[:, :, :SIZE] / y[:, :, SIZE:]], axis=2)
    h = _rows(z) @ p["into"] + p["into_bias"]
    np.maximum(h, 0, out=h)
    return _say(p, h).reshape(n, STRIDE, CLASSES), (e, last, q, k, v, a, y, z, h)


class Reader:
    """The same without a gradient: what an id gives whatever its window is worked out once for every embedding row."""

    def __init__(self, flat: np.ndarray):
        self.p = p = views(flat)
        ones = np.ones((len(p["embed"]), 1), np.float32)
        self.both = np.concatenate([p["embed"] @ p["key"], p["embed"] @ p["value"], ones], axis=1)
        self.query = p["embed"] @ (p["query"] * np.float32(SIZE**-0.5))
        # One more hidden unit, always one, carries the bias of the output.
        self.into = np.concatenate([p["embed"] @ p["into"][:SIZE] + p["into_bias"], ones], axis=1)
        self.value = np.concatenate([p["into"][SIZE:], np.zeros((SIZE, 1), np.float32)], axis=1)
        self.out = np.concatenate([p["out"], p["out_bias"][None]])

    def forward(self, x: np.ndarray, opening: np.ndarray) -> np.ndarray:
        both, last = self.both[x], np.ascontiguousarray(x[:, OVERLAP:])
        _, y = _attend(self.p, self.query[last], both[:, :, :SIZE], np.ascontiguousarray(both[:, :, SIZE:]), opening)
        y = _rows(y)
        h = (y[:, :SIZE] / y[:, SIZE:]) @ self.value
        h += self.into[last.ravel()]
        np.maximum(h, 0, out=h)
        out = h @ self.out
        return np.clip(out, -LIMIT, LIMIT, out=out).reshape(len(x), STRIDE, CLASSES)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, cache: tuple, up: np.ndarray) -> np.ndarray:
    """The flat gradient for ``up``, the slope by what ``forward`` said (where the limit cuts, slopes pass as if it did not)."""
    e, last, q, k, v, a, y, z, h = cache
    flat = np.zeros(LENGTH, np.float32)
    g = views(flat)
    up = _rows(up)
    g["out"][:] = h.T @ up
    g["out_bias"][:] = up.sum(axis=0)
    dh = (up @ p["out"].T) * (h > 0)
    g["into"][:] = _rows(z).T @ dh
    g["into_bias"][:] = dh.sum(axis=0)
    dz = (dh @ p["into"].T).reshape(z.shape)
    dy = np.ascontiguousarray(dz[:, :, SIZE:])
    a = a / y[:, :, SIZE:]
    da = dy @ np.ascontiguousarray(v[:, :, :SIZE].transpose(0, 2, 1))
    dv = np.ascontiguousarray(a.transpose(0, 2, 1)) @ dy
    ds = a * (da - (a * da).sum(axis=2, keepdims=True))
    g["behind"][:] = np.bincount(_BACK.ravel(), ds.sum(axis=0).ravel(), WIDTH)
    dq, dk = ds @ k, np.ascontiguousarray(ds.transpose(0, 2, 1)) @ q
    dq *= np.float32(SIZE**-0.5)
    g["query"][:] = _rows(last).T @ _rows(dq)
    g["key"][:] = _rows(e).T @ _rows(dk)
    g["value"][:] = _rows(e).T @ _rows(dv)
    de = (_rows(dk) @ p["key"].T + _rows(dv) @ p["value"].T).reshape(e.shape)
    de[:, OVERLAP:] += dz[:, :, :SIZE] + (_rows(dq) @ p["query"].T).reshape(last.shape)
    by = np.argsort(x.ravel(), kind="stable")
    rows = x.ravel()[by]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    g["embed"][rows[first]] = np.add.reduceat(_rows(de)[by], first, axis=0)
    return flat


def _weigh(voc: Vocabulary, x: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unscaled class probabilities, their sums) at every target."""
    np.exp(said, out=said)
    said *= voc.after_row[x[:, OVERLAP:]]
    return said, (_rows(said) @ np.ones(CLASSES, np.float32)).reshape(said.shape[:2])


def train(flat: np.ndarray, voc: Vocabulary, batches: Iterator[tuple[np.ndarray, Windows]], rate: float = RATE) -> tuple[np.ndarray, int]:
    """(weights, windows seen) after one Adam step for every ``BATCH`` windows, from the weights ``flat``."""
    flat, seen, step = flat.copy(), 0, 0
    p = views(flat)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for ids, w in batches:
        for at in range(0, len(w.doc), BATCH):
            own = w[slice(at, at + BATCH)]
            x = voc.row_of[ids[own.keys]]
            said, cache = forward(p, x, own.opening)
            share, total = _weigh(voc, x, said)
            share /= total[:, :, None]
            target = voc.class_of[ids[own.targets]]
            np.put_along_axis(share, target[:, :, None], np.take_along_axis(share, target[:, :, None], 2) - 1, 2)
            share *= (own.real / max(own.real.sum(), 1)).astype(np.float32)[:, :, None]
            slope = gradient(p, x, cache, share)
            step += 1
            mean += np.float32(0.1) * (slope - mean)
            square += np.float32(0.01) * (slope * slope - square)
            flat -= np.float32(rate / (1 - 0.9**step)) * mean / (np.sqrt(square / np.float32(1 - 0.99**step)) + np.float32(1e-6))
            seen += len(own.doc)
    return flat, seen


def log_probabilities(flat: np.ndarray, voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray, at_once: int = 256) -> np.ndarray:
    """Natural log probability of each text: the sum over its ids but the leading end id."""
    reader = Reader(flat)
    total = np.zeros(len(bounds) - 1)
    every = windows(bounds)
    for at in range(0, len(every.doc), at_once):
        w = every[slice(at, at + at_once)]
        x = voc.row_of[ids[w.keys]]
        weight, sums = _weigh(voc, x, reader.forward(x, w.opening))
        before, target = ids[w.targets - 1], ids[w.targets]
        own = np.take_along_axis(weight, voc.class_of[target][:, :, None], 2)[:, :, 0]
        own = np.log(own / sums) + voc.within(before, target)
        total += np.bincount(w.doc, np.where(w.real, own, 0).sum(axis=1, dtype=np.float64), len(total))
    return total
