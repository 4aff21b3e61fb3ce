"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Ids are grouped into classes of ``PER_CLASS`` neighbours; the probability of an id is that of its class
times its own within the class. Texts run in lanes side by side: a lane takes one text after another, each
from a state of zeros, and windows of all lanes are worked out together, so that long texts leave no lanes
idle. The states are carried from window to window, so a text's log-likelihood is that of the complete
text. Backpropagation ends at the start of its window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, PER_CLASS, WINDOW, LANES = 32, 64, 16, 128
#: Logits up to here need no shift before exp().
_SAFE = 60


def initial(counts: np.ndarray, hidden: int = HIDDEN, seed: int = 2) -> dict[str, np.ndarray]:
    """Random recurrent weights; outputs that give the ids' frequencies. len(counts) is a multiple of PER_CLASS."""
    rng = np.random.default_rng(seed)
    by_class = (counts + 1.0).reshape(-1, PER_CLASS)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    return {
        "T": draw(len(counts), 3 * hidden),
        "U": draw(hidden, 3 * hidden),
        "C": np.zeros((hidden, len(by_class)), np.float32),
        "c": np.log(by_class.sum(axis=1) / by_class.sum()).astype(np.float32),
        "W": np.zeros((len(counts), hidden), np.float32),
        "w": np.log(by_class / by_class.sum(axis=1, keepdims=True)).ravel().astype(np.float32),
    }


def _states(p: dict, x: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
    """States after each step of the inputs x (steps, lanes); a lane's state is zero before a step that is ``fresh``.

    ``keep`` gets what backpropagation needs.
    """
    size, kind = h.shape[1], p["U"].dtype
    # a logistic is 0.5 * tanh(0.5 * x) + 0.5: the inner half is taken beforehand
    zr, n = p["T"][:, : 2 * size][x], p["T"][:, 2 * size :][x]
    zr *= 0.5
    u_zr, u_n = 0.5 * p["U"][:, : 2 * size], p["U"][:, 2 * size :].copy()
    out, g, prod = np.empty((*x.shape, size), kind), np.empty((*x.shape, size), kind), np.empty((x.shape[1], 2 * size), kind)
    before = np.empty_like(out) if keep is not None else None
    starts = None if fresh is None else fresh.any(axis=1)
    for t in range(len(x)):
        if starts is not None and starts[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        if before is not None:
            before[t] = h
        gates, new = zr[t], n[t]
        gates += np.matmul(h, u_zr, out=prod)
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new += gates[:, size:] * np.matmul(h, u_n, out=g[t])
        np.tanh(new, out=new)
        h = np.subtract(h, new, out=out[t])
        h *= gates[:, :size]
        h += new
    if keep is not None:
        keep |= {"h": before, "zr": zr, "n": n, "g": g}
    return out


def _softmax(x: np.ndarray, own: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities in place of x (if ``whole``), and the logarithm of each row's own."""
    if x.size and not -_SAFE <= x.min() <= x.max() <= _SAFE:  # else no sum leaves the range of single precision
        x -= x.max(axis=1, keepdims=True)
    found = x.ravel()[np.arange(0, x.size, x.shape[1]) + own]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if whole:
        x /= total[:, None]
    return x, found - np.log(total)


def _summed(e: np.ndarray) -> np.ndarray:
    """The sum of the rows; as a product it takes a fraction of the time of sum(axis=0)."""
    return np.ones(len(e), e.dtype) @ e


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """The stable order of ids below ``most``; of 16 bits, numpy makes it by a radix sort."""
    return np.argsort(ids.astype(np.uint16) if most <= 1 << 16 else ids, kind="stable")


def _output(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of y given the states h; with ``grad``, also gives the outputs' gradients and returns that of h."""
    classes, size, kind = len(p["c"]), h.shape[1], p["U"].dtype
    order = _order(y // PER_CLASS, classes)
    y = y[order]
    cls = y // PER_CLASS
    own = y - cls * PER_CLASS
    bounds = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    s = np.ones((len(y), size + 1), kind)  # the last place is the bias
    s[:, :size] = h[order]
    words = np.concatenate([p["W"], p["w"][:, None]], axis=1).reshape(classes, PER_CLASS, size + 1)
    e_class, e_word = s @ np.concatenate([p["C"], p["c"][None]]), np.empty((len(y), PER_CLASS), kind)
    for k, at in spans:
        np.matmul(s[at], words[k].T, out=e_word[at])
    e_class, log_p = _softmax(e_class, cls, grad is not None)
    e_word, log_w = _softmax(e_word, own, grad is not None)
    found = np.empty_like(log_p)
    found[order] = log_p + log_w
    if grad is None:
        return found, None
    e_class.ravel()[np.arange(0, e_class.size, classes) + cls] -= 1
    e_word.ravel()[np.arange(0, e_word.size, PER_CLASS) + own] -= 1
    by_class, by_word = s.T @ e_class, np.zeros_like(words)
    of_words = np.empty((len(y), size), kind)
    for k, at in spans:
        np.matmul(e_word[at].T, s[at], out=by_word[k])
        np.matmul(e_word[at], words[k, :, :size], out=of_words[at])
    grad["C"], grad["c"] = by_class[:size], by_class[size]
    grad["W"], grad["w"] = by_word[..., :size].reshape(-1, size), by_word[..., size].ravel()
    of_words += e_class @ p["C"].T
    dh = np.empty_like(of_words)
    dh[order] = of_words
    return found, dh


def windows(texts: list[np.ndarray], first: int, window: int | None = None, lanes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, text or -1, whether a text starts), each (steps, lanes); ``first`` precedes each text.

    Lanes are filled by length, the longest texts first; there are no more of them than the longest text leaves work for.
    Those that end earlier come last, and later windows lack them.
    """
    lens = np.array([len(x) for x in texts], np.int64)
    total = int(lens.sum())
    if not total:
        return
    width = int(min(lanes or LANES, np.count_nonzero(lens), -(-4 * total // lens.max())))  # what is laid out stays in proportion to the texts
    load, of = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for i in np.argsort(-lens, kind="stable").tolist():
        if lens[i]:
            n, k = load[0]
            of[k].append(i)
            heapq.heapreplace(load, (n + int(lens[i]), k))
    of.sort(key=lambda mine: -lens[mine].sum())
    loads = np.array([lens[mine].sum() for mine in of])
    x, y, doc, fresh = (np.zeros((width, loads[0]), kind) for kind in (np.int32, np.int32, np.int32, bool))
    doc -= 1
    for k, (mine, n) in enumerate(zip(of, loads, strict=True)):
        y[k, :n] = np.concatenate([texts[i] for i in mine])
        x[k, 1:n] = y[k, : n - 1]
        starts = np.cumsum(lens[mine]) - lens[mine]
        x[k, starts], fresh[k, starts] = first, True
        doc[k, :n] = np.repeat(np.array(mine, np.int32), lens[mine])
    step = window or WINDOW
    for t in range(0, loads[0], step):
        part = (slice(0, int(np.searchsorted(-loads, -t, side="left"))), slice(t, t + step))
        yield x[part].T, y[part].T, doc[part].T, fresh[part].T


def log_likelihood(p: dict, texts: list[np.ndarray], first: int) -> np.ndarray:
    """Natural log probability of each text."""
    out, h = np.zeros(len(texts)), None
    for x, y, doc, fresh in windows(texts, first, 2 * WINDOW, 2 * LANES):
        s = _states(p, x, np.zeros((x.shape[1], p["U"].shape[0]), np.float32) if h is None else h[: x.shape[1]], fresh)
        on = doc >= 0
        found, _ = _output(p, s[on], y[on])
        out += np.bincount(doc[on], found, len(out))
        h = s[-1]
    return out


class Trainer:
    """Adagrad on the mean loss of each window."""

    def __init__(self, p: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None, rate: float = 0.15):
        self.p, self.rate, self.seen = {k: v.copy() for k, v in p.items()}, rate, 0
        self.squares = {k: np.full_like(v, 1e-3) if squares is None else squares[k].copy() for k, v in p.items()}

    def train(self, texts: list[np.ndarray], first: int) -> None:
        """One pass over some texts, in lanes side by side."""
        h = None
        for x, y, doc, fresh in windows(texts, first):
            h = self._step(x, y, doc >= 0, fresh, np.zeros((x.shape[1], self.p["U"].shape[0]), np.float32) if h is None else h[: x.shape[1]])

    def _step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, size, keep, grad = self.p, h.shape[1], {}, {}
        s = _states(p, x, h, fresh, keep)
        if mask.all():
            ds = _output(p, s.reshape(-1, size), y.ravel(), grad)[1].reshape(s.shape)
        else:
            ds = np.zeros_like(s)
            ds[mask] = _output(p, s[mask], y[mask], grad)[1]
        z, r, n = keep["zr"][..., :size], keep["zr"][..., size:], keep["n"]
        of_n = (1 - z) * (1 - n * n)
        # what the products with a step's state get, for a unit at the step's output
        units = np.empty((*x.shape, 3, size), s.dtype)
        of_r = units[..., 2, :]
        np.multiply((keep["h"] - n) * z, 1 - z, out=units[..., 0, :])
        np.multiply(of_n, r, out=of_r)
        np.multiply(of_r * keep["g"], 1 - r, out=units[..., 1, :])
        back, turned, ends = np.zeros_like(h, s.dtype), p["U"].T.copy(), fresh.any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            d, unit = ds[t], units[t]
            d += back
            unit *= d[:, None]
            np.matmul(unit.reshape(len(d), -1), turned, out=back)
            back += d * z[t]
            if ends[t]:
                back[fresh[t]] = 0
        grad["U"] = keep["h"].reshape(-1, size).T @ units.reshape(-1, 3 * size)
        np.multiply(of_n, ds, out=of_r)  # the input isn't behind the reset gate
        count = int(mask.sum())
        self.seen += count
        order = _order(x.ravel(), len(p["w"]))
        of = x.ravel()[order]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        dt = np.add.reduceat(units.reshape(-1, 3 * size)[order], starts, axis=0)
        for k, g in grad.items():
            self._move(p[k], self.squares[k], g / count, ...)
        self._move(p["T"], self.squares["T"], dt / count, of[starts])
        return s[-1]

    def _move(self, value: np.ndarray, squares: np.ndarray, g: np.ndarray, at) -> None:
        np.clip(g, -1, 1, out=g)
        total = squares[at]
        total += g * g
        if at is not ...:
            squares[at] = total
        g *= self.rate
        g /= np.sqrt(total)
        value[at] -= g


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
