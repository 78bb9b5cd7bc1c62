"""A small causal self-attention model in numpy.

Tokens come in classes. A window of embeddings passes one masked attention head with a
bias for each distance; the class of the next token is read from the token before it
and what it attends to. The token itself follows by its share of the class. Windows
overlap: the first half of a window is context, the second half is scored, so every
token is scored once.
"""

from __future__ import annotations

import numpy as np

CLASSES = 128  # 0 pads, 1 is the end of a text
WIDTH = 16
CONTEXT = 16  # tokens of context before the first scored one, and scored at a time
PAD, END = 0, 1


def start_weights(log_prior: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """First weights; the output starts at the classes' overall shares."""
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.normal(size=shape) * 0.1).astype(np.float32)
    return {
        "embed": draw(CLASSES, WIDTH),
        "query": draw(WIDTH, WIDTH),
        "key": draw(WIDTH, WIDTH),
        "value": draw(WIDTH, WIDTH),
        "distance": np.zeros(2 * CONTEXT, dtype=np.float32),
        "near": draw(CLASSES, CLASSES) * np.float32(0),
        "far": draw(WIDTH, CLASSES),
        "bias": log_prior.astype(np.float32),
    }


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()]).astype(np.float64)


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, w in like.items():
        out[name] = np.asarray(flat[at : at + w.size], dtype=np.float32).reshape(w.shape)
        at += w.size
    return out


def windows(classes: np.ndarray) -> np.ndarray:
    """Overlapping windows of a text's classes: context, then the scored half.

    The text is padded at both ends; row k scores tokens k * CONTEXT onward.
    """
    n = len(classes)
    rows = -(-n // CONTEXT)
    padded = np.full((rows + 1) * CONTEXT, PAD, dtype=np.int64)
    padded[CONTEXT : CONTEXT + n] = classes
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * CONTEXT)[::CONTEXT]


_POS = np.arange(2 * CONTEXT - 1)
_ASKS = _POS[CONTEXT - 1 :]  # places whose next token is scored
_GAP = _ASKS[:, None] - _POS[None, :]
_FUTURE = _GAP < 0
_NEAREST = np.where(_FUTURE, 0, _GAP)
#: Exponents that need no shift: their sums neither overflow nor vanish in 32 bits.
SAFE = 60
_ROOMS: dict[tuple, np.ndarray] = {}


def _room(name: str, kind: np.dtype, *shape: int) -> np.ndarray:
    """Memory of a worker for one step's array: new memory for each costs more than the step."""
    size = int(np.prod(shape))
    if (name, kind) not in _ROOMS or _ROOMS[name, kind].size < size:
        _ROOMS[name, kind] = np.empty(size, dtype=kind)
    return _ROOMS[name, kind][:size].reshape(shape)


def _rows(name: str, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``rows[which]`` in the room of that name."""
    return rows.take(which, axis=0, out=_room(name, rows.dtype, *which.shape, rows.shape[1]), mode="clip")


class Tables:
    """What each class brings into the products, worked out once for all windows."""

    def __init__(self, w: dict[str, np.ndarray]):
        embed = w["embed"]
        self.ask = embed @ w["query"] * embed.dtype.type(WIDTH**-0.5)
        self.key, self.value = embed @ w["key"], embed @ w["value"]
        # the ones add up an asking place's weights beside their products
        self.held = np.hstack([self.key, self.value, np.ones((len(embed), 1), embed.dtype)])
        self.distance = np.where(_FUTURE, embed.dtype.type(-1e9), w["distance"][_NEAREST])
        self.far = w["far"]
        self.next = w["near"] + w["bias"]
        self.next -= self.next.max(axis=1, keepdims=True)
        asked = np.abs(self.ask @ self.key.T).max() + np.abs(w["distance"]).max()
        self.wide = not max(asked, np.abs(self.value @ self.far).max()) < SAFE


def attend(t: Tables, x: np.ndarray):
    """What each scored place attends to, [rows, CONTEXT, WIDTH], and what training needs."""
    seen = x[:, :-1]
    last = seen[:, CONTEXT - 1 :]
    q, held = _rows("asked", t.ask, last), _rows("held", t.held, seen)
    a = _room("shares", q.dtype, *last.shape, seen.shape[1])
    np.matmul(q, held[:, :, :WIDTH].transpose(0, 2, 1), out=a)
    a += t.distance
    if t.wide:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= (seen != PAD).astype(a.dtype)[:, None, :]
    # a text's first token has padding alone before it
    a[last[:, 0] == PAD, 0, :CONTEXT] = 1
    both = np.matmul(a, held[:, :, WIDTH:], out=_room("both", q.dtype, *last.shape, WIDTH + 1))
    norm = both[:, :, WIDTH:]
    seen_far = np.divide(both[:, :, :WIDTH], norm, out=_room("far", q.dtype, *last.shape, WIDTH))
    return seen_far, (seen, last, q, held, a, norm)


def _logits(t: Tables, seen_far: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Logits up to a number for each row that does not change their shares."""
    logits = np.matmul(seen_far, t.far, out=_room("logits", t.far.dtype, len(last), CLASSES))
    logits += _rows("next", t.next, last)
    if t.wide:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_probs(w: dict[str, np.ndarray] | Tables, x: np.ndarray) -> np.ndarray:
    """Natural log of each scored token's class probability, [rows, CONTEXT]."""
    t = w if isinstance(w, Tables) else Tables(w)
    seen_far, (_, last, *_) = attend(t, x)
    last, target = last.ravel(), x[:, CONTEXT:].ravel()
    logits = _logits(t, seen_far.reshape(-1, WIDTH), last)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    return (own - np.log(logits @ np.ones(CLASSES, logits.dtype))).reshape(-1, CONTEXT)


def _runs(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes that occur, and where the run of each begins and ends once they are sorted."""
    counts = np.bincount(classes, minlength=CLASSES)
    kinds, ends = np.flatnonzero(counts), np.cumsum(counts)
    return kinds, (ends - counts)[kinds], ends[kinds]


def _by_class(order: np.ndarray, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each class; ``order`` sorts them by class."""
    total = np.zeros((CLASSES, rows.shape[1]), dtype=rows.dtype)
    kinds, begins, _ = _runs(classes)
    total[kinds] = np.add.reduceat(_rows("sorted", rows, order), begins, axis=0)
    return total


def _sorted(classes: np.ndarray) -> np.ndarray:
    return np.argsort(classes.astype(np.uint8), kind="stable")


def gradient(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean loss over the scored tokens that are no padding."""
    t = Tables(w)
    seen_far, (seen, last, q, held, a, norm) = attend(t, x)
    a /= norm
    # the logits' rows are kept in the order of the last token's class
    last, target = last.ravel(), x[:, CONTEXT:].ravel()
    order = _sorted(last)
    ranked, goal, what = last[order], target[order], seen_far.reshape(-1, WIDTH)[order]
    logits = _logits(t, what, ranked)
    p = np.exp(logits, out=logits)  # not divided by their sums: the weights are
    share = (goal != PAD).astype(p.dtype)
    share /= max(1.0, share.sum())
    weight = share / (p @ np.ones(CLASSES, p.dtype))
    g = {name: np.zeros_like(value) for name, value in w.items()}
    for kind, low, high in zip(*_runs(last)):
        g["near"][kind] = weight[low:high] @ p[low:high]
    pairs = np.bincount(ranked * CLASSES + goal, weights=share, minlength=CLASSES**2)
    g["near"] -= pairs.reshape(CLASSES, CLASSES).astype(p.dtype)
    g["bias"] = g["near"].sum(0)
    g["far"] = (what * weight[:, None]).T @ p - _by_class(_sorted(goal), goal, what * share[:, None]).T
    d_far = np.empty_like(what)
    d_far[order] = (p @ t.far.T) * weight[:, None] - w["far"].T[goal] * share[:, None]
    d_far = d_far.reshape(seen_far.shape)

    d_s = np.matmul(d_far, held[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=_room("d_shares", a.dtype, *a.shape))
    d_s -= (d_far * seen_far).sum(axis=2, keepdims=True)
    d_s *= a
    gaps = np.where(_FUTURE, 0, d_s.sum(0))
    g["distance"] += np.bincount(_NEAREST.ravel(), gaps.ravel(), 2 * CONTEXT).astype(a.dtype)
    mat = lambda m: m.reshape(-1, m.shape[-1])
    d_q = _by_class(order, last, mat(np.matmul(d_s, held[:, :, :WIDTH], out=_room("d_asked", a.dtype, *q.shape)))) * a.dtype.type(WIDTH**-0.5)
    d_held = _room("d_held", a.dtype, *seen.shape, 2 * WIDTH)
    d_held[:, :, :WIDTH] = np.matmul(d_s.transpose(0, 2, 1), q, out=_room("d_one", a.dtype, *seen.shape, WIDTH))
    d_held[:, :, WIDTH:] = np.matmul(a.transpose(0, 2, 1), d_far, out=_room("d_one", a.dtype, *seen.shape, WIDTH))
    seen = seen.ravel()
    d_k, d_v = np.hsplit(_by_class(_sorted(seen), seen, mat(d_held)), 2)
    g["query"], g["key"], g["value"] = (w["embed"].T @ d for d in (d_q, d_k, d_v))
    g["embed"] = d_q @ w["query"].T + d_k @ w["key"].T + d_v @ w["value"].T
    return g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = 0.02):
        self.w, self.rate, self.steps = w, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.s = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, x: np.ndarray) -> None:
        self.steps += 1
        rate = self.rate / (1 + self.steps / 200)
        for name, g in gradient(self.w, x).items():
            self.m[name] += 0.1 * (g - self.m[name])
            self.s[name] += 0.01 * (g * g - self.s[name])
            m = self.m[name] / (1 - 0.9**self.steps)
            s = self.s[name] / (1 - 0.99**self.steps)
            self.w[name] -= (rate * m / (np.sqrt(s) + 1e-6)).astype(np.float32)
