"""A linear-chain conditional random field in NumPy: hashed word features, batched forward-backward and Viterbi."""

from __future__ import annotations

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)
FEATURES = 1 << 16
PER_WORD = 12
GAPS = 4  # no blank, blank, line break, empty line or edge of the text


def word_features(word: str) -> list[int]:
    """Hashed word-shape features of one canonical word."""
    low = word.lower()
    shape = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    short = "".join(c for i, c in enumerate(shape) if i == 0 or shape[i - 1] != c)
    kind = "n" if word.isdigit() else "a" if word.isalpha() else "m" if word.isalnum() else "s"
    feats = [
        f"w={low}" if len(low) < 24 else "w=long",
        f"s={short[:6]}",
        f"k={kind}{min(len(word), 15)}",
        f"c={kind}{'U' if word.isupper() else 'T' if word[:1].isupper() else 'l'}",
        f"p2={low[:2]}",
        f"p3={low[:3]}",
        f"p4={low[:4]}",
        f"e2={low[-2:]}",
        f"e3={low[-3:]}",
        f"e4={low[-4:]}",
        f"n={word[:1]}{len(word)}" if kind == "n" else f"t={kind}{word[:1].isupper()}{low[-3:]}",
        "bias",
    ]
    return [_slot(f) for f in feats]


def _slot(feature: str) -> int:
    h = 1469598103934665603
    for b in feature.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h >> 17) % FEATURES


class Model:
    """Weights: per offset and feature, per gap before and after, label to label."""

    def __init__(self, labels: int):
        self.labels = labels
        self.word = np.zeros((len(OFFSETS), FEATURES, labels), np.float32)
        self.gap = np.zeros((2, GAPS, labels), np.float32)
        self.step = np.zeros((labels, labels), np.float32)

    def tables(self, feats: np.ndarray) -> np.ndarray:
        """(offsets, words, labels): score of each word as seen from each offset."""
        return self.word[:, feats].sum(2)


def scores(tables: np.ndarray, gap: np.ndarray, words: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """(tokens, labels) emission scores of one long token stream."""
    n = len(words)
    out = tables[OFFSETS.index(0)][words] + gap[0][gaps]
    for k, o in enumerate(OFFSETS):
        if o < 0:
            out[-o:] += tables[k][words[:o]]
        elif o > 0:
            out[:-o] += tables[k][words[o:]]
    out[: n - 1] += gap[1][gaps[1:]]
    return out


def train(sentences: list[tuple[list[str], list[int], list[int]]], labels: int, steps: int = 90, penalty: float = 0.1) -> Model:
    """Fit by penalised likelihood with L-BFGS on the whole table. A sentence: words, gaps before them, labels."""
    vocabulary: dict[str, int] = {"": 0}
    length = max(len(s[0]) for s in sentences) + 2
    n = len(sentences)
    words = np.zeros((n, length), np.int64)
    gaps = np.full((n, length), 3, np.int64)
    gold = np.zeros((n, length), np.int64)
    real = np.zeros((n, length), np.float32)
    for i, (ws, gs, ls) in enumerate(sentences):
        for j, w in enumerate(ws):
            words[i, j + 1] = vocabulary.setdefault(w, len(vocabulary))
        m = len(ws)
        gaps[i, 1 : m + 1], gold[i, 1 : m + 1], real[i, : m + 2] = gs, ls, 1
    feats = np.array([[_slot("edge")] * PER_WORD, *[word_features(w) for w in list(vocabulary)[1:]]], np.int64)
    used, local = np.unique(feats, return_inverse=True)
    local = local.reshape(feats.shape)
    flat_words, flat_gaps = words.ravel(), gaps.ravel()
    sizes = [len(OFFSETS) * len(used) * labels, 2 * GAPS * labels, labels * labels]
    cuts = np.cumsum([0, *sizes])
    view = lambda x: (x[: cuts[1]].reshape(len(OFFSETS), len(used), labels), x[cuts[1] : cuts[2]].reshape(2, GAPS, labels), x[cuts[2] :].reshape(labels, labels))
    gold_hot = np.eye(labels, dtype=np.float32)[gold]
    inner = real[:, 1:] * real[:, :-1]
    gold_step = np.zeros((labels, labels), np.float32)
    np.add.at(gold_step, (gold[:, :-1][inner > 0], gold[:, 1:][inner > 0]), 1)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, g, h = view(x)
        e = scores(w[:, local].sum(2), g, flat_words, flat_gaps).reshape(n, length, labels)
        right_score = float((np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0] * real).sum() + (gold_step * h).sum())
        top = e.max(2)
        pot, hop = np.exp(e - top[:, :, None]), np.exp(h)
        alpha, beta = np.empty_like(pot), np.ones_like(pot)
        total = pot[:, 0].sum(1)
        alpha[:, 0] = pot[:, 0] / total[:, None]
        log_z = float((np.log(total) * real[:, 0]).sum() + (top * real).sum())
        for t in range(1, length):
            a = (alpha[:, t - 1] @ hop) * pot[:, t]
            total = a.sum(1)
            log_z += float((np.log(total) * real[:, t]).sum())
            alpha[:, t] = np.where(real[:, t, None] > 0, a / total[:, None], alpha[:, t - 1])
        expected = np.zeros((labels, labels), np.float32)
        for t in range(length - 2, -1, -1):
            right = pot[:, t + 1] * beta[:, t + 1]
            b = right @ hop.T
            live = real[:, t + 1, None] > 0
            beta[:, t] = np.where(live, b / b.sum(1, keepdims=True), 1)
            norm = ((alpha[:, t] @ hop) * right).sum(1, keepdims=True)
            expected += hop * (np.where(live, alpha[:, t] / np.maximum(norm, 1e-30), 0).T @ right)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        diff = ((post - gold_hot) * real[:, :, None]).reshape(-1, labels)
        grad = np.zeros(len(x), np.float32)
        gw, gg, gh = view(grad)
        for k, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), len(diff) - max(0, o)
            seen = flat_words[lo + o : hi + o]
            for y in range(labels):
                per_word = np.bincount(seen, weights=diff[lo:hi, y], minlength=len(feats))
                gw[k, :, y] = np.bincount(local.ravel(), weights=np.repeat(per_word, feats.shape[1]), minlength=len(used))
        for j in range(GAPS):
            gg[0, j] = diff[flat_gaps == j].sum(0)
            gg[1, j] = diff[:-1][flat_gaps[1:] == j].sum(0)
        gh[:] = expected - gold_step
        return log_z - right_score + 0.5 * penalty * float(x @ x), grad + penalty * x

    x = _lbfgs(loss, np.zeros(cuts[-1], np.float32), steps)
    model = Model(labels)
    w, g, h = view(x)
    model.word[:, used], model.gap[:], model.step[:] = w, g, h
    return model


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * float(s @ q)
            back.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= max(1.0, float(np.abs(g).sum()) ** 0.5)
        for (s, y, rho), a in zip(past, reversed(back), strict=True):
            q += (a - rho * float(y @ q)) * s
        slope, size = -float(g @ q), 1.0
        if slope >= 0:
            past.clear()
            continue
        while True:
            new = x - size * q
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * size * slope or size < 1e-4:
                break
            size *= 0.4
        s, y = new - x, g_new - g
        done = abs(f - f_new) < 1e-5 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if float(s @ y) > 1e-10:
            past = [*past[-memory + 1 :], (s, y, 1 / float(s @ y))]
        if done:
            break
    return x


def viterbi(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of a batch of equally long windows: (windows, time, labels) -> (windows, time).

    Labels are outside, then begin and inside of each kind; an inside follows
    only its own begin or inside. Arrays run over the windows, which are many.
    """
    n, length, labels = e.shape
    e = np.ascontiguousarray(e.transpose(1, 2, 0))
    sources = [[y, y - 1] if y and y % 2 == 0 else list(range(labels)) for y in range(labels)]
    best = np.empty_like(e)
    best[0] = e[0]
    best[0, 2::2] -= 100
    cand = np.empty(n, np.float32)
    for t in range(1, length):
        old, new = best[t - 1], best[t]
        for y, froms in enumerate(sources):
            np.add(old[froms[0]], step[froms[0], y], out=new[y])
            for f in froms[1:]:
                np.add(old[f], step[f, y], out=cand)
                np.maximum(new[y], cand, out=new[y])
        new += e[t]
    allowed = step.copy()
    for y, froms in enumerate(sources):
        allowed[[f for f in range(labels) if f not in froms], y] = -1e6
    out = np.empty((n, length), np.int8)
    at = best[-1].argmax(0)
    out[:, -1] = at
    for t in range(length - 1, 0, -1):
        at = (best[t - 1] + allowed[:, at]).argmax(0)
        out[:, t - 1] = at
    return out
