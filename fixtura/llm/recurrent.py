"""A gated recurrent language model over token numbers, on arrays: a class-factored softmax and truncated backpropagation.

Tokens below ``n_words`` are words, in classes of CLASS_WORDS consecutive ones; each further token is a class of its own.
Token END ends a text and is read before its first token.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np

END = 0
CLASS_WORDS = 64
EMBEDDING = 16
STATE = 16
LANES = 512
WINDOW = 16
RATE = 0.1
HIGHEST = 60.0
ABSENT = -1e4
# Parameters with one step size per row (the others have one per entry).
BY_ROW = ("embedding", "words")

Parameters = dict[str, np.ndarray]


def fresh(word_counts: np.ndarray, class_counts: np.ndarray) -> Parameters:
    """Parameters that predict by counts alone: of words, zero for those that only fill up a class, and of classes."""
    rng, n_words = np.random.default_rng(0), len(word_counts)
    tokens = n_words + len(class_counts) - n_words // CLASS_WORDS
    p = {
        "embedding": rng.normal(0, 0.3, (tokens, EMBEDDING)), "input": rng.normal(0, 0.3, (EMBEDDING, 3 * STATE)), "bias": np.zeros(3 * STATE),
        "recurrent": rng.normal(0, 0.2, (STATE, 3 * STATE)),
        "classes": np.vstack([np.zeros((STATE, len(class_counts))), np.log(class_counts + 1.0) - np.log(class_counts.sum() + 1.0)]),
        "words": np.column_stack([np.zeros((n_words, STATE)), np.where(word_counts > 0, np.log(np.maximum(word_counts, 1.0) / (word_counts.sum() + 1.0)), ABSENT)]),
    }
    p["bias"][STATE : 2 * STATE] = 0.5
    return {k: v.astype(np.float32) for k, v in p.items()}


def fresh_steps(p: Parameters) -> Parameters:
    """Summed squares of gradients, from which step sizes follow."""
    return {k: np.full(v.shape[:1] if k in BY_ROW else v.shape, 1.0, np.float32) for k, v in p.items()}


def lanes(sizes: np.ndarray, count: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(lane, place of the first token) for texts of given sizes, longest first into the shortest lane; lane 0 is the longest."""
    heap = [(0, i) for i in range(count)]
    heapify(heap)
    lane, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        at[i], lane[i] = heap[0]
        heapreplace(heap, (heap[0][0] + int(sizes[i]), heap[0][1]))
    length = np.bincount(lane, sizes, count)
    rank = np.empty(count, np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(count)
    return rank[lane], at


def _exponentials(states: np.ndarray, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of all logits, their sum per row, and the logarithm of the probability of entry ``at``. Logits are cut
    at HIGHEST; states lie in [-1, 1], so the weights tell whether any could be higher."""
    logits = states @ weights
    if np.abs(weights[:-1]).sum(axis=0).max() + weights[-1].max() > HIGHEST:
        np.minimum(logits, HIGHEST, out=logits)
    picked = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return logits, total, picked - np.log(total)


def _sorted(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0; of 16 bits, where they fit, as those are sorted by digits."""
    small = len(numbers) and numbers.max() < 1 << 15
    return np.argsort(numbers.astype(np.int16) if small else numbers, kind="stable")


def _step(p: Parameters, steps: Parameters, name: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
    if name in BY_ROW:
        size = steps[name][rows] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        steps[name][rows] = size
        p[name][rows] -= g * (RATE / np.sqrt(size))[:, None]
    else:
        steps[name] += g * g
        p[name] -= RATE * g / np.sqrt(steps[name])


def _states(a: np.ndarray, w: np.ndarray, keep: np.ndarray, h: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The state after the window; those after its steps go into ``after``. As ``window`` does when it trains, but nothing is kept
    for a way back, gates and new states have arrays of their own, and lanes that all go on are not multiplied by one."""
    s = h.shape[1]
    of_gates, of_new = (np.ascontiguousarray(w[:, k]) for k in (slice(0, 2 * s), slice(2 * s, None)))
    to_gates, to_new = (np.ascontiguousarray(a[:, :, k]) for k in (slice(0, 2 * s), slice(2 * s, None)))
    whole, held = keep.all(axis=(1, 2)), np.empty(to_new.shape, np.float32)
    for t in range(len(a)):
        hp = h if whole[t] else h * keep[t]
        g = hp @ of_gates
        g += to_gates[t]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        n = hp @ of_new
        n *= g[:, :s]
        n += to_new[t]
        np.tanh(n, out=n)
        h = np.subtract(hp, n, out=held[t])
        h *= g[:, s:]
        h += n
    after[:, :, :s] = held
    return h


def window(p: Parameters, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray, steps: Parameters | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(state after the window, natural logarithm of the probability of every ``y``).

    The last row of ``classes`` and the last column of ``words`` are their biases. ``x``: tokens read, ``y``: tokens that follow, both (time, lane), -1 where a lane has ended; ``keep``: whether the state goes
    on, else it starts anew; ``h``: state per lane. With ``steps``, parameters are moved along the gradient through this window's time steps. A gate is (1 + tanh) / 2.
    """
    (time, width), n_words, s, w = x.shape, len(p["words"]), STATE, p["recurrent"]
    n_groups = n_words // CLASS_WORDS
    e = p["embedding"][x]
    a = (e.reshape(-1, EMBEDDING) @ p["input"] + p["bias"]).reshape(time, width, 3 * s)
    after = np.ones((time, width, s + 1), np.float32)
    if steps is None:
        h = _states(a, w, keep, h, after)
    else:
        before, gates, new, inner = (np.empty((time, width, k), np.float32) for k in (s, 2 * s, s, s))
        for t in range(time):
            hp = np.multiply(h, keep[t], out=before[t])
            hw = hp @ w
            g = np.add(a[t, :, : 2 * s], hw[:, : 2 * s], out=gates[t])
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            inner[t] = hw[:, 2 * s :]
            n = np.multiply(g[:, :s], inner[t], out=new[t])
            n += a[t, :, 2 * s :]
            np.tanh(n, out=n)
            h = np.subtract(hp, n, out=after[t, :, :s])
            h *= g[:, s:]
            h += n
    states, target = after.reshape(-1, s + 1), y.ravel()
    live = np.flatnonzero(target >= 0)
    if len(live) < len(target):
        states, target = states[live], target[live]
    is_word = target < n_words
    group = np.where(is_word, target // CLASS_WORDS, target - (n_words - n_groups))
    powers, total, logp = _exponentials(states, p["classes"], group)
    order = np.flatnonzero(is_word)
    order = order[_sorted(group[order])]
    cuts = np.searchsorted(group[order], np.arange(n_groups + 1))
    at, own, found = target[order] % CLASS_WORDS, states[order], np.empty(len(order), np.float32)
    if steps is not None:
        # Exponentials over their sum are probabilities; the sum is put into the narrow factor.
        powers[np.arange(len(group)), group] -= total
        down = powers @ p["classes"][:s].T
        down /= total[:, None]
        grads = {"classes": (states / total[:, None]).T @ powers, "words": np.zeros_like(p["words"])}
        of_words = np.empty((len(order), s), np.float32)
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        i, rows = slice(cuts[c], cuts[c + 1]), slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        powers, total, found[i] = _exponentials(own[i], p["words"][rows].T, at[i])
        if steps is not None:
            powers[np.arange(len(total)), at[i]] -= total
            of_words[i] = powers @ p["words"][rows, :s] / total[:, None]
            grads["words"][rows] = powers.T @ (own[i] / total[:, None])
    logp[order] += found
    out = np.zeros(y.size, np.float32)
    out[live] = logp
    if steps is None or not len(live):
        return h, out.reshape(time, width)
    down[order] += of_words
    full = down
    if len(live) < y.size:
        full = np.zeros((y.size, s), np.float32)
        full[live] = down
    full = full.reshape(time, width, s)
    r, z = gates[:, :, :s], gates[:, :, s:]
    to_new, to_reset, to_update = (1 - z) * (1 - new * new), 2 * inner * r * (1 - r), 2 * (before - new) * z * (1 - z)
    dw, dn, back, turned = np.empty_like(a), np.empty_like(new), np.zeros((width, s), np.float32), np.ascontiguousarray(w.T)
    for t in reversed(range(time)):
        dh = np.add(full[t], back, out=full[t])
        np.multiply(dh, to_new[t], out=dn[t])
        np.multiply(dn[t], to_reset[t], out=dw[t, :, :s])
        np.multiply(dh, to_update[t], out=dw[t, :, s : 2 * s])
        np.multiply(dn[t], r[t], out=dw[t, :, 2 * s :])
        np.matmul(dw[t], turned, out=back)
        back += dh * z[t]
        back *= keep[t]
    grads["recurrent"] = before.reshape(-1, s).T @ dw.reshape(-1, 3 * s)
    dw[:, :, 2 * s :] = dn
    da, tokens = dw.reshape(-1, 3 * s), x.ravel()
    grads |= {"input": e.reshape(-1, EMBEDDING).T @ da, "bias": da.sum(axis=0)}
    de = da @ p["input"].T
    by = _sorted(tokens)
    first = np.flatnonzero(np.r_[True, np.diff(tokens[by]) != 0])
    for name, g in grads.items():
        _step(p, steps, name, g)
    _step(p, steps, "embedding", np.add.reduceat(de[by], first), tokens[by][first])
    return h, out.reshape(time, width)


def read(p: Parameters, tokens: np.ndarray, sizes: np.ndarray, steps: Parameters | None = None, piece: int | None = None,
         width: int = LANES, time: int = WINDOW) -> np.ndarray:
    """Natural logarithm of the probability of each text. ``tokens``: texts one after another, each with its END;
    texts lie side by side in lanes, and the state goes on from window to window to the end of each.

    With ``piece``, texts are read in pieces of that many tokens, each from a new state, and each piece has a result. ``width``
    lanes and windows of ``time`` tokens change speed and, with ``steps``, how far gradients go back, but no probability.
    """
    if piece:
        count = -(-sizes // piece)
        last = np.cumsum(count) - 1
        ends = sizes - (count - 1) * piece
        sizes = np.full(int(count.sum()), piece)
        sizes[last] = ends
    if not len(sizes):
        return np.zeros(0)
    lane, at = lanes(sizes, width)
    long, start = int((at + sizes).max()), np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    place, across = np.arange(len(tokens)) - start[own] + at[own], lane[own]
    x, y = np.full((long, width), END, np.int32), np.full((long, width), -1, np.int32)
    x[place[1:], across[1:]] = tokens[:-1]
    y[place, across] = tokens
    x[place[0], across[0]] = END
    keep = np.ones((long, width, 1), bool)
    keep[at, lane] = False
    length = np.bincount(lane, sizes, width).astype(int)
    logp = np.zeros((long, width), np.float32)
    h = np.zeros((width, STATE), np.float32)
    for t in range(0, long, time):
        part = slice(t, t + time), slice(0, int((length > t).sum()))
        h, logp[part] = window(p, x[part], y[part], keep[part], h[part[1]], steps)
    return np.add.reduceat(logp[place, across].astype(float), start)
