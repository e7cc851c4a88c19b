"""A gated recurrent network over symbols in numpy, with a class-factored softmax and truncated backpropagation.

Symbols are numbered by class: symbol s is word s % WIDTH of class s // WIDTH, and P(s | h) = P(class | h) P(s | class, h),
so a step costs CLASSES + WIDTH outputs and not their product. Texts run in lanes side by side; a lane takes the next text
when one ends, with a fresh state, and the state is carried from window to window, so a text of any length is read whole.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, WIDTH, WINDOW = 24, 32, 64, 32
SYMBOLS = CLASSES * WIDTH
END, TAIL = 0, 1
SAFE = 60.0  # exponentials of such numbers, and their sums, are far from the bounds of 32-bit floats
Weights = dict[str, np.ndarray]
SHAPES = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "bn": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
          "ww": (CLASSES, HIDDEN, WIDTH), "bw": (CLASSES, WIDTH)}


def start(share: np.ndarray) -> Weights:
    """Weights whose outputs are the given shares of the symbols whatever the state."""
    rng = np.random.default_rng(5)
    w = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    w["x"] += rng.normal(0, 0.3, SHAPES["x"]).astype(np.float32)
    w["u"] += rng.normal(0, HIDDEN**-0.5, SHAPES["u"]).astype(np.float32)
    by_class = share.reshape(CLASSES, WIDTH)
    w["bc"] += np.log(by_class.sum(1) + 1e-12).astype(np.float32)
    w["bw"] += np.log(by_class / (by_class.sum(1, keepdims=True) + 1e-30) + 1e-12).astype(np.float32)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at: at + n].reshape(s).astype(np.float32)
        at += n
    return out


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to n lanes, the longest first, each to the lane with the least so far."""
    out: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for text in np.argsort(-lengths, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        out[i].append(text)
        heapq.heappush(heap, (load + int(lengths[text]), i))
    return out


def grid(symbols: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (step, lane): the place of the target in `symbols` (-1 for none), the symbol before it, and whether a text starts."""
    lengths = np.diff(ends)
    dealt = [d for d in lanes(lengths, min(width, len(lengths))) if d]
    dealt.sort(key=lambda d: -int(lengths[d].sum()))  # live lanes stay at the front
    steps = int(lengths[dealt[0]].sum())
    place = np.full((steps, len(dealt)), -1, np.int64)
    for lane, texts in enumerate(dealt):
        at = np.concatenate([np.arange(ends[t], ends[t + 1]) for t in texts])
        place[: len(at), lane] = at
    first = np.zeros(len(symbols), bool)
    first[ends[:-1]] = True
    before = np.where(first, END, np.append(END, symbols[:-1]))
    return place, np.where(place >= 0, before[place], END), (place >= 0) & first[place]


def forward(w: Weights, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after every step of a window, the last state, and what backpropagation needs."""
    k = HIDDEN
    states = np.empty((len(x), len(h), k), np.float32)
    inputs, starts = w["x"][x], fresh.any(1)
    saved = [np.empty((len(x), len(h), n), np.float32) for n in (k, 2 * k, k, k)] if keep else None
    for t in range(len(x)):
        if starts[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        inner = h @ w["u"]
        gates = inputs[t, :, : 2 * k] + inner[:, : 2 * k]
        gates *= np.float32(0.5)  # the logistic function by the hyperbolic tangent
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        m = inner[:, 2 * k:] + w["bn"]
        n = gates[:, k:] * m
        n += inputs[t, :, 2 * k:]
        np.tanh(n, out=n)
        if keep:
            for part, value in zip(saved, (h, gates, m, n), strict=True):
                part[t] = value
        h = np.subtract(h, n, out=states[t])
        h *= gates[:, :k]
        h += n
    return states, h, saved


def _level(x: np.ndarray) -> np.ndarray:
    """x, less the largest of each row where exponentials could run over or vanish otherwise; it may be overwritten."""
    if x.size and max(float(x.max()), -float(x.min())) > SAFE:
        x -= x.max(1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The logarithms of a softmax over the rows of x at one place of each; x is overwritten."""
    x = _level(x)
    got = x[np.arange(len(x)), place]
    return got - np.log(np.exp(x, out=x).sum(1))


def log_probabilities(w: Weights, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of symbols after states."""
    order = np.argsort(symbols // WIDTH, kind="stable")  # a class is a slice
    states, symbols = states[order], symbols[order]
    kind, word = symbols // WIDTH, symbols % WIDTH
    got = _log_softmax_at(states @ w["wc"] + w["bc"], kind).astype(np.float64)
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[c], cuts[c + 1])
        got[at] += _log_softmax_at(states[at] @ w["ww"][c] + w["bw"][c], word[at])
    out = np.empty(len(symbols))
    out[order] = got
    return out


def score(w: Weights, symbols: np.ndarray, ends: np.ndarray, width: int = 256) -> np.ndarray:
    """The natural log-probability of every text; text i has symbols[ends[i]:ends[i + 1]], the last of them END."""
    if len(ends) < 2:
        return np.zeros(0)
    place, x, fresh = grid(symbols, ends, width)
    live = (place >= 0).sum(1)
    each = np.zeros(len(symbols))
    h = np.zeros((place.shape[1], HIDDEN), np.float32)
    at = 0
    while at < len(place):
        to = min(at + WINDOW, len(place))
        n = int(live[at])  # lanes that have run out are at the back
        states, last, _ = forward(w, x[at:to, :n], fresh[at:to, :n], h[:n])
        h = last
        spot = place[at:to, :n].ravel()
        on = spot >= 0
        each[spot[on]] = log_probabilities(w, states.reshape(-1, HIDDEN)[on], symbols[spot[on]])
        at = to
    return np.diff(np.append(0, np.cumsum(each))[ends])


def _step_back(x: np.ndarray, place: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss of a softmax over the rows of x at their targets, and what goes back into x, which is overwritten."""
    x = _level(x)
    at = np.arange(len(x)), place
    loss = -float(x[at].sum(dtype=np.float64))
    np.exp(x, out=x)
    total = x.sum(1, keepdims=True)
    loss += float(np.log(total).sum(dtype=np.float64))
    x /= total
    x[at] -= 1
    return loss, x


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, on: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """Loss, gradients and last state of one window; no gradient goes back beyond its first step."""
    k = HIDDEN
    states, last, (before, gates, m, n) = forward(w, x, fresh, h, keep=True)
    # targets in order of class, so that a class is a slice
    where, target = np.flatnonzero(on), y[on]
    order = np.argsort(target // WIDTH, kind="stable")
    where, target = where[order], target[order]
    s, total = states.reshape(-1, k)[where], max(1, len(target))
    kind, word = target // WIDTH, target % WIDTH
    g = {name: np.zeros_like(w[name]) for name in ("x", "ww", "bw")}
    loss, d = _step_back(s @ w["wc"] + w["bc"], kind)
    g["wc"], g["bc"] = s.T @ d, d.sum(0)
    ds = d @ w["wc"].T
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[c], cuts[c + 1])
        part, d = _step_back(s[at] @ w["ww"][c] + w["bw"][c], word[at])
        loss += part
        np.matmul(s[at].T, d, out=g["ww"][c])
        d.sum(0, out=g["bw"][c])
        ds[at] += d @ w["ww"][c].T
    out = np.zeros((x.size, k), np.float32)
    out[where] = ds / np.float32(total)
    out = out.reshape(*x.shape, k)
    z, r = gates[:, :, :k], gates[:, :, k:]
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), m * r * (1 - r)
    stays, starts, back = ~fresh[:, :, None], fresh.any(1), np.ascontiguousarray(w["u"].T)
    dh = np.zeros_like(h)
    dx = np.empty((*x.shape, 3 * k), np.float32)
    du = np.empty_like(dx)
    for t in range(len(x) - 1, -1, -1):
        dh += out[t]
        dn, step = dx[t, :, 2 * k:], du[t]
        np.multiply(dh, by_n[t], out=dn)
        np.multiply(dh, by_z[t], out=step[:, :k])
        np.multiply(dn, by_r[t], out=step[:, k: 2 * k])
        np.multiply(dn, r[t], out=step[:, 2 * k:])
        dh *= z[t]
        dh += step @ back
        if starts[t]:
            dh *= stays[t]
    dx[:, :, : 2 * k] = du[:, :, : 2 * k]
    g["u"] = before.reshape(-1, k).T @ du.reshape(-1, 3 * k)
    g["bn"] = du[:, :, 2 * k:].sum((0, 1))
    order = np.argsort(x.ravel(), kind="stable")
    seen = x.ravel()[order]
    begin = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    g["x"][seen[begin]] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], begin, axis=0)
    for name in ("wc", "bc", "ww", "bw"):
        g[name] /= np.float32(total)
    return loss / total, g, last


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}
        self.rate, self.turn = rate, 0

    def step(self, w: Weights, g: Weights, share: float = 1.0) -> None:
        """One step, which uses up the gradients; a window that is only partly filled moves the weights by its share."""
        self.turn += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        clip = min(1.0, 1.0 / (norm + 1e-12))
        fix = np.float32(self.rate * share / (1 - 0.9**self.turn) * np.sqrt(1 - 0.99**self.turn))
        for k in w:
            x, m, v = g[k], self.m[k], self.v[k]
            x *= np.float32(clip)
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            x *= x
            x *= np.float32(0.01)
            v *= np.float32(0.99)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= fix
            w[k] -= x


def train(w: Weights, opt: Adam, symbols: np.ndarray, ends: np.ndarray, width: int = 64) -> float:
    """One pass over texts by truncated backpropagation; the mean loss of a symbol."""
    if len(ends) < 2:
        return 0.0
    place, x, fresh = grid(symbols, ends, width)
    h = np.zeros((place.shape[1], HIDDEN), np.float32)
    losses = []
    live = (place >= 0).sum(1)
    for at in range(0, len(place), WINDOW):
        n = int(live[at])
        spot = place[at: at + WINDOW, :n]
        loss, g, h = gradients(w, x[at: at + WINDOW, :n], symbols[spot], spot >= 0, fresh[at: at + WINDOW, :n], h[:n])
        opt.step(w, g, (spot >= 0).sum() / (WINDOW * width))
        losses.append(loss)
    return float(np.mean(losses))
