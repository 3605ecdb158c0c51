"""A small causal self-attention model over subword ids, trained and run in numpy.

One attention layer with a residual, one hidden layer, and a softmax in two steps: over
classes, then over the members of a class.  The most frequent subwords are classes of their
own; the next ones are members of groups, by what stands beside them; all others share a last
member of their group, each with its smoothed share of that member's occurrences.  Both
softmaxes depend on the context.
Texts are scored in windows of ``WINDOW`` inputs that overlap by ``WINDOW - STRIDE``; every
id is a target once, with at least the overlap as context (but for the text's beginning).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 24, 20
WIDTH, HIDDEN = 16, 24
#: Classes of one subword; groups, and the members of each, of which the last is all the rest.
ALONE, GROUPED, MEMBERS = 32, 20, 64
CLASSES = ALONE + GROUPED
#: Subwords with an embedding of their own; the others share their class's.
OWN = ALONE + GROUPED * (MEMBERS - 1)
BEGIN, END, VOCABULARY = 49406, 49407, 49408
#: Windows scored at a time.
CHUNK = 256
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


@dataclass
class Classes:
    #: Of each id: its class, its place in its group, log10 of its share of that place, its embedding.
    class_of: np.ndarray
    member_of: np.ndarray
    share: np.ndarray
    row_of: np.ndarray
    #: Occurrences of each class, and of each member of each group.
    seen: np.ndarray
    seen_members: np.ndarray


@dataclass
class Model:
    params: dict[str, np.ndarray]
    of: Classes

    def log10_probabilities(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of each id's probability; text i is ids[bounds[i]:bounds[i + 1]], its end included."""
        out = np.empty(len(ids), np.float32)
        n = np.diff(bounds)
        windows = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), windows)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
        rows, classes, members = self.of.row_of[ids], self.of.class_of[ids], self.of.member_of[ids]
        begin = self.of.row_of[BEGIN]
        steps = np.arange(WINDOW)
        for a in range(0, len(text), CHUNK):
            t, s = text[a : a + CHUNK], start[a : a + CHUNK]
            place = s[:, None] + steps  # of the target in its text; its input stands before it
            inside = place < n[t][:, None]
            target = np.minimum(bounds[t][:, None] + place, len(ids) - 1)
            source = np.where(place > 0, rows[np.maximum(target - 1, 0)], begin)
            wanted = inside & ((steps >= WINDOW - STRIDE) | (s == 0)[:, None])
            wanted = np.flatnonzero(wanted)
            order, grouped, cut = _by_class(classes[target.ravel()[wanted]])
            wanted = wanted[order]
            at = target.ravel()[wanted]
            f = self.top(_flat(self.mixed(source))[wanted])
            logits = self.logits(f)
            found = logits[np.arange(len(at)), classes[at]]
            found -= np.log(np.exp(logits, out=logits) @ _ONES[:CLASSES])
            z = self.member_logits(f[grouped], cut)
            mine = z[np.arange(len(z)), members[at[grouped]]]
            found[grouped] += mine - np.log(np.exp(z, out=z) @ _ONES[:MEMBERS])
            out[at] = found
        return out * np.float32(np.log10(np.e)) + self.of.share[ids]

    def attend(self, source: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs, q, k, v, weights) of windows of embedding rows."""
        p = self.params
        h = np.take(p["embed"], source, axis=0)
        h += p["place"]
        q, k, v = np.split(_times(h, p["qkv"]), 3, axis=2)
        w = q @ k.transpose(0, 2, 1)
        np.exp(np.clip(w, -20, 20, out=w), out=w)
        w *= _CAUSAL.astype(w.dtype)
        w *= 1 / _sums(w)
        return h, q, k, v, w

    def mixed(self, source: np.ndarray) -> np.ndarray:
        h, _, _, v, w = self.attend(source)
        h += _times(w @ v, self.params["out"])
        return h

    def top(self, r: np.ndarray) -> np.ndarray:
        """The hidden layer, and a last column of ones for the biases."""
        w = np.zeros((WIDTH, HIDDEN + 1), r.dtype)
        w[:, :HIDDEN] = self.params["w1"]
        f = r @ w
        f += np.append(self.params["b1"], r.dtype.type(1))
        return np.maximum(f, 0, out=f)

    def logits(self, f: np.ndarray) -> np.ndarray:
        z = f @ self.params["w2"]
        return np.minimum(z, 40, out=z)

    def member_logits(self, f: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Those of rows sorted by group."""
        z = np.empty((len(f), MEMBERS), f.dtype)
        for g in range(GROUPED):
            if cut[g + 1] > cut[g]:
                np.matmul(f[cut[g] : cut[g + 1]], self.params["w3"][g], out=z[cut[g] : cut[g + 1]])
        return np.minimum(z, 40, out=z)


def _sums(w: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays."""
    return (w.reshape(-1, w.shape[-1]) @ np.ones(w.shape[-1], w.dtype)).reshape(*w.shape[:-1], 1)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m as one product; numpy would make one of each window."""
    return (_flat(x) @ m).reshape(*x.shape[:-1], m.shape[1])


def _by_group(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the targets whose class is a group, by group, and where each group begins."""
    order = np.argsort(classes, kind="stable")
    cut = np.searchsorted(classes[order], np.arange(ALONE, CLASSES + 1))
    return order[cut[0] :], cut - cut[0]


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, slice, np.ndarray]:
    """Places of the targets, the grouped ones last; where these are, and in them each group."""
    grouped, cut = _by_group(classes)
    return np.concatenate([np.flatnonzero(classes < ALONE), grouped]), slice(len(classes) - len(grouped), len(classes)), cut


def alone(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by falling count, class of each id): the most frequent ids have classes of their own."""
    order = np.argsort(-counts, kind="stable")
    class_of = np.full(VOCABULARY, ALONE, np.int16)
    class_of[order[:ALONE]] = np.arange(ALONE)
    return order, class_of


def neighbours(a: np.ndarray, b: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Places in a matrix of VOCABULARY by 2 ALONE of the frequent ids after and before each
    id, of pairs a, b of which b follows a."""
    keys = []
    for left, right, shift in ((a, b, 0), (b, a, ALONE)):
        c = class_of[right].astype(np.int64)
        known = c < ALONE
        keys.append(left[known].astype(np.int64) * (2 * ALONE) + c[known] + shift)
    return np.concatenate(keys)


def classes(counts: np.ndarray, near: np.ndarray) -> Classes:
    """Classes from the counts of all ids and the matrix of their frequent neighbours."""
    counts = counts.astype(np.float64)
    order, class_of = alone(counts)
    rest = order[ALONE:]
    x = np.sqrt(near[rest] / np.maximum(near[rest].sum(1, keepdims=True), 1))
    met = np.flatnonzero(counts[rest] > 0)
    centres = x[:GROUPED].copy()
    for _ in range(6 if len(met) else 0):
        cell = (x[met] @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        for g in np.unique(cell):
            centres[g] = x[met[cell == g]].mean(0)
    cell = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
    # the most frequent of the rest, by cell, fill the groups' places in turn
    own = np.argsort(cell[: OWN - ALONE], kind="stable")
    group, member = np.empty(len(rest), np.int64), np.full(len(rest), MEMBERS - 1)
    place = np.arange(len(own))
    group[own], member[own] = place // (MEMBERS - 1), place % (MEMBERS - 1)
    first = np.searchsorted(cell[own], np.arange(GROUPED))
    of_cell = np.minimum(first, len(own) - 1) // (MEMBERS - 1)
    group[len(own) :] = of_cell[cell[len(own) :]]
    class_of[rest] = ALONE + group
    member_of = np.zeros(VOCABULARY, np.int16)
    member_of[rest] = member
    row_of = np.empty(VOCABULARY, np.int32)
    row_of[order[:OWN]] = np.arange(OWN)
    row_of[order[OWN:]] = OWN + class_of[order[OWN:]]
    slot = np.where(class_of < ALONE, class_of.astype(np.int64), ALONE + (class_of.astype(np.int64) - ALONE) * MEMBERS + member_of)
    smooth = counts + 0.1
    share = np.log10(smooth / np.bincount(slot, smooth)[slot]).astype(np.float32)
    seen = np.bincount(class_of, counts, minlength=CLASSES)
    seen_members = np.bincount(slot, counts, minlength=ALONE + GROUPED * MEMBERS)[ALONE:].reshape(GROUPED, MEMBERS)
    return Classes(class_of, member_of, share, row_of, seen, seen_members)


def classes_of(windows: np.ndarray) -> Classes:
    """Classes from windows alone."""
    counts = np.bincount(windows[windows >= 0], minlength=VOCABULARY)
    near = np.zeros(VOCABULARY * 2 * ALONE, np.float32)
    a, b = windows[:, :-1].ravel(), windows[:, 1:].ravel()
    both = (a >= 0) & (b >= 0)
    np.add.at(near, neighbours(a[both], b[both], alone(counts)[1]), 1)
    return classes(counts, near.reshape(VOCABULARY, 2 * ALONE))


def untrained(of: Classes) -> Model:
    rng = np.random.default_rng(5)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    p = {
        "embed": draw(0.3, OWN + CLASSES, WIDTH), "place": draw(0.05, WINDOW, WIDTH), "qkv": draw(0.15, WIDTH, 3 * WIDTH), "out": draw(0.1, WIDTH, WIDTH),
        "w1": draw(0.2, WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(0.1, HIDDEN + 1, CLASSES), "w3": draw(0.1, GROUPED, HIDDEN + 1, MEMBERS),
    }
    p["w2"][HIDDEN] = np.log((of.seen + 1) / (of.seen.sum() + CLASSES))
    p["w3"][:, HIDDEN] = np.log((of.seen_members + 0.5) / (of.seen_members + 0.5).sum(1, keepdims=True))
    return Model(p, of)


class Adam:
    """Steps on a model's parameters, in place."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in model.params.items()} for _ in range(2))

    def step(self, w: np.ndarray, rate: float) -> None:
        self.t += 1
        m, s, p, t = self.m, self.s, self.model.params, self.t
        now = rate * min(1, t / 30) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for k, v in _gradients(self.model, w).items():
            m[k] *= m[k].dtype.type(0.9)
            s[k] *= s[k].dtype.type(0.99)
            m[k] += v * v.dtype.type(0.1)
            v *= v
            v *= v.dtype.type(0.01)
            s[k] += v
            root = np.sqrt(s[k], out=v)
            root += root.dtype.type(1e-8)
            np.divide(m[k], root, out=root)
            root *= root.dtype.type(now)
            p[k] -= root


def train(windows: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.01, of: Classes | None = None) -> Model:
    """Trains on windows of WINDOW + 1 ids, the first of each only an input; -1 fills."""
    model = untrained(classes_of(windows) if of is None else of)
    if not len(windows):
        return model
    rng = np.random.default_rng(6)
    adam = Adam(model)
    for t in range(1, steps + 1):
        adam.step(windows[rng.integers(0, len(windows), batch)], rate * (1 - 0.95 * t / steps))
    return model


def cut(seq: np.ndarray) -> np.ndarray:
    """Windows of WINDOW + 1 ids of which every id but the first is a target once; -1 fills."""
    n = max(1, -(-(len(seq) - 1) // WINDOW))
    padded = np.full(n * WINDOW + 1, -1, np.int32)
    padded[: len(seq)] = seq
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::WINDOW]


def _row_sums(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    width = values.shape[1]
    at = (rows.astype(np.int64) * width)[:, None] + np.arange(width)
    return np.bincount(at.ravel(), values.ravel(), size * width).astype(values.dtype).reshape(size, width)


def _less_chosen(e: np.ndarray, chosen: np.ndarray, scale: float) -> np.ndarray:
    """From logits, in place: their softmax less the chosen column's one, times scale."""
    np.exp(e, out=e)
    e *= (scale / (e @ np.ones(e.shape[1], e.dtype)))[:, None]
    e[np.arange(len(e)), chosen] -= scale
    return e


def _gradients(model: Model, w: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of a batch of windows."""
    p, of = model.params, model.of
    source = of.row_of[np.where(w[:, :-1] >= 0, w[:, :-1], BEGIN)]
    wanted = w[:, 1:].ravel()
    real = np.flatnonzero(wanted >= 0)
    order, grouped, cut = _by_class(of.class_of[wanted[real]])
    real = real[order]  # targets only, those in groups last
    ids = wanted[real]
    h, q, k, v, a = model.attend(source)
    mixed = a @ v
    r = (_flat(h) + _flat(mixed) @ p["out"])[real]
    f = model.top(r)
    scale = f.dtype.type(1 / max(1, len(ids)))
    d = _less_chosen(model.logits(f), of.class_of[ids], scale)
    g = {"w2": f.T @ d, "w3": np.zeros_like(p["w3"])}
    df = d @ p["w2"].T
    part = f[grouped]
    e = _less_chosen(model.member_logits(part, cut), of.member_of[ids[grouped]], scale)
    more = np.empty_like(part)
    for i in range(GROUPED):
        if cut[i + 1] > cut[i]:
            at = slice(cut[i], cut[i + 1])
            np.matmul(part[at].T, e[at], out=g["w3"][i])
            np.matmul(e[at], p["w3"][i].T, out=more[at])
    df[grouped] += more
    df *= f > 0
    df = df[:, :HIDDEN]  # the last is of the column of ones
    g |= {"w1": r.T @ df, "b1": np.ones(len(df), df.dtype) @ df}
    dr = np.zeros_like(h)
    _flat(dr)[real] = df @ p["w1"].T
    g["out"] = _flat(mixed).T @ _flat(dr)
    dmixed = _times(dr, p["out"].T)
    ds = dmixed @ v.transpose(0, 2, 1)
    ds -= _sums(dmixed * mixed)
    ds *= a
    dqkv = np.empty((*ds.shape[:2], 3 * WIDTH), ds.dtype)
    dqkv[..., :WIDTH] = ds @ k
    dqkv[..., WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ q
    dqkv[..., 2 * WIDTH :] = a.transpose(0, 2, 1) @ dmixed
    g["qkv"] = _flat(h).T @ _flat(dqkv)
    dr += _times(dqkv, p["qkv"].T)
    g["place"] = dr.sum(0)
    g["embed"] = _row_sums(_flat(dr), source.ravel(), len(p["embed"]))
    return g
