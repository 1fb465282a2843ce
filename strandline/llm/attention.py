"""A small causal self-attention model over subword classes, trained in numpy.

Subwords are grouped into classes (of word-initial and of other subwords) by what stands before
them. One attention layer with a learned bias per distance and one hidden layer predict from the
subwords before it whether the next one begins a word, and its class among those that do or do not; a
table of corpus counts gives the subword within its class, after the class of the one before it in the word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class AttentionConfig:
    width: int = 16
    hidden: int = 32
    #: A window holds so many subwords before and up to the last scored one; half of them are scored.
    window: int = 32
    #: Classes of word-initial subwords (one is for rare ones, one for the end) and of others.
    initial: int = 100
    inner: int = 92
    steps: int = 1200
    batch: int = 96
    rate: float = 2e-2
    #: Windows of a step, and the first rate, when a block of the corpus is learned from.
    tune_batch: int = 256
    tune_rate: float = 2e-3
    seed: int = 11


@dataclass
class Classes:
    """class of each subword id; ids: the model's subwords, then the end."""

    of: np.ndarray
    initial: int
    count: int
    end: int
    #: Row of the embedding table for each subword id; rare ones share a row for each class.
    row: np.ndarray
    rows: int


#: Subwords whose neighbours span the space in which all subwords are put into classes.
FREQUENT = 1500


def frequent(counts: np.ndarray, size: int) -> np.ndarray:
    return np.array([i for i in np.argsort(-counts, kind="stable").tolist() if counts[i] >= 5 and i != size][:FREQUENT], dtype=np.int64)


@dataclass
class Space:
    """Where subwords lie by what stands before them, and the classes' centres of each kind."""

    total: np.ndarray
    axes: np.ndarray
    centres: dict[bool, tuple[int, np.ndarray]]

    def points(self, before: np.ndarray) -> np.ndarray:
        """``before``: how often each frequent subword, or any other (last), stands before each row's."""
        expected = before.sum(1, keepdims=True) * self.total[None] / max(1.0, self.total.sum())
        return np.log((before + 0.1) / (expected + 0.1)) @ self.axes

    def near(self, points: np.ndarray, start: bool) -> np.ndarray:
        first, centre = self.centres[start]
        return first + ((points[:, None, :] - centre[None]) ** 2).sum(-1).argmin(1)


def classes_of(counts: np.ndarray, before: np.ndarray, starts: np.ndarray, size: int, config: AttentionConfig) -> tuple[Classes, Space]:
    """``counts`` of all ids; ``before``: as for ``Space.points``, a row for each frequent subword."""
    total = config.initial + config.inner
    seen = frequent(counts, size)
    space = Space(before.sum(0), np.zeros((len(seen) + 1, 0)), {})
    if len(seen):
        space.axes = np.eye(len(seen) + 1)
        signal = space.points(before)
        space.axes = np.linalg.svd(signal, full_matrices=False)[2][:24].T
        points = space.points(before)
    of = np.where(starts, config.initial - 2, total - 1).astype(np.int64)
    of[size] = config.initial - 1
    kind = starts[seen]
    for first, k, pick in ((0, config.initial - 2, kind), (config.initial, config.inner - 1, ~kind)):
        chosen = np.flatnonzero(pick)
        if len(chosen) == 0:
            continue
        space.centres[first == 0] = (first, points[chosen[:k]])  # the most frequent ones
        centre = space.centres[first == 0][1]
        for _ in range(12):
            near = space.near(points[chosen], first == 0) - first
            for c in range(len(centre)):
                if (near == c).any():
                    centre[c] = np.average(points[chosen[near == c]], axis=0, weights=counts[seen[chosen[near == c]]])
        of[seen[chosen]] = first + near
    row = len(seen) + of
    row[seen] = np.arange(len(seen))
    return Classes(of, config.initial, total, size, row, len(seen) + total + 1), space  # the last row: before a text


def make_classes(stream: np.ndarray, starts: np.ndarray, size: int, config: AttentionConfig) -> Classes:
    """``stream``: ids with ends (id ``size``); ``starts``: which ids are word-initial."""
    counts = np.bincount(stream, minlength=size + 1)
    seen = frequent(counts, size)
    number = np.full(size + 1, len(seen), dtype=np.int64)
    number[seen] = np.arange(len(seen))
    before = np.zeros((len(seen) + 1, len(seen) + 1))
    np.add.at(before, (number[stream[1:]], number[stream[:-1]]), 1.0)
    return classes_of(counts, before[: len(seen)], starts, size, config)[0]


class Room:
    """Arrays that are used again: getting fresh memory takes longer than small arithmetic."""

    def __init__(self, dtype: np.dtype = np.dtype(F32)) -> None:
        self.dtype = dtype
        self.have: dict[str, np.ndarray] = {}

    def take(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.have or self.have[name].size < size:
            self.have[name] = np.empty(size, self.dtype)
        return self.have[name][:size].reshape(shape)


@cache
def _distances(inputs: int, scored: int) -> np.ndarray:
    return np.arange(inputs - scored, inputs)[:, None] - np.arange(inputs)[None]


#: Places whose classes are told at once in learning: what they take stays in a core's cache.
AT_ONCE = 512


@dataclass
class Model:
    config: AttentionConfig
    classes: Classes
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def init(self) -> None:
        c, r = self.config, np.random.default_rng(self.config.seed)
        make = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(F32)
        d = c.width
        self.w = {"E": (r.normal(size=(self.classes.rows, d)) * 0.5).astype(F32), "Q": make(d, d), "K": make(d, d), "V": make(d, d), "P": make(d, d), "A": make(d, c.hidden), "a": np.zeros(c.hidden, F32), "B": make(c.hidden, d), "O": make(d, self.classes.count), "o": np.zeros(self.classes.count, F32), "G": make(d, 1), "g": np.zeros(1, F32), "D": np.zeros(c.window, F32)}

    def _bias(self, inputs: int, scored: int) -> tuple[np.ndarray, np.ndarray]:
        distance = _distances(inputs, scored)
        return distance, np.where(distance >= 0, self.w["D"].take(distance, mode="clip"), F32(-1e9)).astype(F32, copy=False)

    def _products(self) -> np.ndarray:
        """What makes of an embedding its query, as it meets other embeddings, and its value as the layer adds it."""
        w = self.w
        return np.concatenate([w["Q"] @ w["K"].T, w["V"] @ w["P"]], axis=1)

    def _forward(self, rows: np.ndarray, scored: int, room: Room | None = None):
        # A row for each feature, all places of all windows side by side: arithmetic runs along the places.
        w, (m, n), d = self.w, rows.shape, self.config.width
        room = room or Room(w["E"].dtype)
        x = room.take("x", d, m * n)
        x[:] = w["E"].take(rows.reshape(-1), axis=0, out=room.take("rows", m * n, d), mode="clip").T
        last = x.reshape(d, m, n)[:, :, n - scored :].reshape(d, -1)
        made = np.matmul(self._products().T, x, out=room.take("made", 2 * d, m * n)).reshape(2 * d, m, n)
        q, v = made[:d, :, n - scored :], made[d:]
        distance, bias = self._bias(n, scored)
        a = np.matmul(q.transpose(1, 2, 0), x.reshape(d, m, n).transpose(1, 0, 2), out=room.take("a", m, scored, n))
        a += bias
        # Weights up to the factor 1 / each.
        a, each = self._exp(a.reshape(-1, n), room, "attention")
        each = 1 / each
        a = a.reshape(m, scored, n)
        mixed = room.take("mixed", d, m, scored)
        np.matmul(v.transpose(1, 0, 2), a.transpose(0, 2, 1), out=mixed.transpose(1, 0, 2))
        mixed = mixed.reshape(d, -1)
        mixed *= each
        # With a row of ones, so that products with them hold the added weights too.
        u = room.take("u", d + 1, m * scored)
        u[d] = 1
        np.add(mixed, last, out=u[:d])
        hidden = np.matmul(np.concatenate([w["A"], w["a"][None]]).T, u, out=room.take("hidden", w["A"].shape[1], m * scored))
        np.maximum(hidden, 0, out=hidden)
        y = np.matmul(w["B"].T, hidden, out=room.take("y", d, m * scored))
        y += u[:d]
        return x, q, v, a, each, mixed, u, hidden, distance, y.reshape(d, m, scored).transpose(1, 2, 0)

    def places(self) -> np.ndarray:
        """For each row of the embedding table: itself, its query as it meets other embeddings, and its value as the layer adds it."""
        e = self.w["E"]
        return np.concatenate([e, e @ self._products()], axis=1)

    def class_logs(self, runs: np.ndarray, first: np.ndarray, target: np.ndarray, at: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs at the places ``at`` of all runs but the first: of the target class among its kind, and of its kind.

        ``runs``: what ``places`` has for each place of runs that stand in a row; ``first``: which of them, without
        the first, begin a text, so what stands before them is not seen; ``target``: the classes at ``at``.
        """
        w, c, d = self.w, self.classes, self.config.width
        n, scored = len(runs) - 1, runs.shape[1]
        # Each run beside the one before it, without a copy.
        seen = np.lib.stride_tricks.as_strided(runs, (n, 2 * scored, 3 * d), runs.strides, writeable=False)
        a = np.matmul(runs[1:, :, d : 2 * d], seen[:, :, :d].transpose(0, 2, 1), out=room.take("a", n, scored, 2 * scored))
        a += self._bias(2 * scored, scored)[1]
        a[first, :, :scored] = -1e9
        e, each = self._exp(a.reshape(-1, 2 * scored), room)
        u = np.matmul(e.reshape(a.shape), seen[:, :, 2 * d :], out=room.take("u", n, scored, d)).reshape(-1, d).take(at, axis=0)
        u /= each.take(at)[:, None]
        u += runs[1:].reshape(-1, 3 * d)[:, :d].take(at, axis=0)
        hidden = np.matmul(u, w["A"], out=room.take("hidden", len(u), w["A"].shape[1]))
        hidden += w["a"]
        np.maximum(hidden, 0, out=hidden)
        u += hidden @ w["B"]
        initial = target < c.initial
        gate = u @ w["G"][:, 0] + w["g"]
        np.negative(gate, out=gate, where=initial)
        kind = -np.maximum(gate, 0) - np.log(1 + np.exp(-np.abs(gate)))
        within = np.zeros(len(u), F32)
        for some, start, stop in ((np.flatnonzero(initial), 0, c.initial), (np.flatnonzero(~initial), c.initial, c.count)):
            if len(some):
                z = np.matmul(u.take(some, axis=0), w["O"][:, start:stop], out=room.take("z", len(some), stop - start))
                z += w["o"][start:stop]
                e, each = self._exp(z, room)
                within[some] = np.log(e[np.arange(len(e)), target[some] - start] + F32(1e-30)) - np.log(each)
        return within, kind

    @staticmethod
    def _exp(z: np.ndarray, room: Room, name: str = "exp") -> tuple[np.ndarray, np.ndarray]:
        """exp of rows, each up to a factor, and the rows' sums; the largest is taken out only where it matters."""
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.exp(z, out=room.take(name, *z.shape))
            sums = e @ np.ones(z.shape[1], F32)
        far = np.flatnonzero(~((sums > 1e-20) & (sums < 1e30)))
        if len(far):
            e[far] = np.exp(z[far] - z[far].max(-1, keepdims=True))
            sums[far] = e[far].sum(-1)
        return e, sums

    def train(self, stream: np.ndarray) -> float:
        """Adam on random windows of the sample; the mean loss of the last steps."""
        self.init()
        c, r = self.config, np.random.default_rng(self.config.seed + 1)
        n = c.window
        if len(stream) <= n + 1:
            return float("nan")
        rows, classes = self.classes.row[stream], self.classes.of[stream]
        # What follows an end begins a text.
        rows = np.where(stream == self.classes.end, self.classes.rows - 1, rows)
        losses, room, adam = [], Room(), Adam(self.w)
        for step in range(1, c.steps + 1):
            at = r.integers(0, len(stream) - n - 1, c.batch)[:, None] + np.arange(n)[None]
            loss, g = self._gradient(rows[at], classes[at + 1], room)
            losses.append(loss)
            adam.step(g, c.rate * min(1.0, step / 30) * (1 - 0.9 * step / c.steps))
        return float(np.mean(losses[-50:]))

    def own_rows(self, ids: np.ndarray) -> None:
        """Give each of ``ids`` a row of its own, at first that of its class."""
        c, size = self.classes, len(self.w["E"])
        row = c.row.copy()
        row[ids] = size - 1 + np.arange(len(ids))
        e = self.w["E"]
        self.w["E"] = np.concatenate([e[:-1], e[c.row[ids]], e[-1:]])
        self.classes = Classes(c.of, c.initial, c.count, c.end, row, size + len(ids))

    def tune(self, stream: np.ndarray) -> np.ndarray:
        """Adam over the whole stream, each subword the target once; how often each row was before one."""
        c, classes, n = self.config, self.classes, self.config.window
        rows_of = classes.row.astype(np.int64)
        rows_of[classes.end] = classes.rows - 1
        rows, target = rows_of[stream[:-1]], classes.of[stream[1:]]
        known = max(0, len(stream) - 1)
        whole = known // n
        order = np.random.default_rng(c.seed + 2).permutation(whole)
        spans = [order[k : k + c.tune_batch, None] * n + np.arange(n)[None] for k in range(0, whole, c.tune_batch)]
        if known > whole * n:
            spans.append(np.arange(whole * n, known)[None])
        room, adam = Room(), Adam(self.w)
        for step, at in enumerate(spans, 1):
            rate = c.tune_rate * min(1.0, step / 10) * (1 - (step - 1) / len(spans)) * min(1.0, at.size / (c.tune_batch * n))
            adam.step(self._gradient(rows[at], target[at], room, with_loss=False)[1], rate)
        return np.bincount(rows, minlength=classes.rows)

    def _gradient(self, rows: np.ndarray, target: np.ndarray, room: Room | None = None, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss (0 where it is not wanted) and its gradient."""
        w, c, (m, n), d = self.w, self.classes, rows.shape, self.config.width
        room = room or Room(w["E"].dtype)
        x, q, v, a, each, mixed, u, hidden, distance, y = self._forward(rows, n, room)
        at, size, kind = target.reshape(-1), rows.size, w["E"].dtype.type
        # Places whose next subword begins a word come first: a class is told among those of its kind, so the other kind's logits are not needed.
        initial = at < c.initial
        order = np.concatenate([np.flatnonzero(initial), np.flatnonzero(~initial)])
        back = np.empty(size, np.int64)
        back[order] = np.arange(size)
        first = int(np.count_nonzero(initial))
        ys = room.take("ys", d + 1, size)
        ys[d] = 1
        y.transpose(2, 0, 1).reshape(d, size).take(order, axis=1, out=ys[:d], mode="clip")
        at = at.take(order)
        # The gate: is it one that begins a word.
        begins = 1 / (1 + np.exp(-np.clip(np.append(w["G"][:, 0], w["g"]) @ ys, -30, 30)))
        loss = -float(np.log(begins[:first]).sum() + np.log(1 - begins[first:]).sum()) / size if with_loss else 0.0
        begins[:first] -= 1
        begins *= kind(1 / size)
        of_gate = ys @ begins
        dys = room.take("dys", d, size)
        out = np.concatenate([w["O"], w["o"][None]])
        of_out = np.zeros_like(out.T)
        for start, end, low, high in ((0, first, 0, c.initial), (first, size, c.initial, c.count)):
            some = np.ascontiguousarray(out[:, low:high].T)
            weights = np.ascontiguousarray(out[:d, low:high])
            for begin in range(start, end, AT_ONCE):  # what stands in a core's cache
                part = slice(begin, min(begin + AT_ONCE, end))
                mine = ys[:, part]
                p, sums = self._exp_columns(np.matmul(some, mine, out=room.take("z", high - low, mine.shape[1])), room)
                here = (at[part] - low) * mine.shape[1] + np.arange(mine.shape[1])
                flat = p.reshape(-1)
                if with_loss:
                    loss -= float((np.log(flat[here] + kind(1e-30)) - np.log(sums)).sum()) / size
                # Up to the factor 1 / (sums * size) what the logits should change by.
                flat[here] -= sums
                scale = kind(1 / size) / sums
                of_out[low:high] += p @ (mine * scale).T
                np.multiply(weights @ p, scale, out=dys[:, part])
        dys += w["G"] * begins
        dy = dys.take(back, axis=1, out=room.take("dy", d, size), mode="clip")
        dh = np.matmul(w["B"], dy, out=room.take("dh", *hidden.shape))
        dh *= hidden > 0
        of_a = u @ dh.T
        g = {"O": of_out[:, :d].T, "o": of_out[:, d], "G": of_gate[:d, None], "g": of_gate[d:], "B": hidden @ dy.T, "A": of_a[:d], "a": of_a[d]}
        du = np.matmul(w["A"], dh, out=room.take("du", d, size))
        du += dy
        # From here on what weights up to a factor meet is scaled by it.
        dm = np.multiply(du, each, out=room.take("dm", d, size))
        scaled = dm.reshape(d, m, n)
        da = np.matmul(scaled.transpose(1, 2, 0), v.transpose(1, 0, 2), out=room.take("da", m, n, n))
        # Each row's sum of its weights' changes is what it mixed, times what that should change by.
        mixed *= dm
        da -= mixed.sum(0).reshape(m, n, 1)
        da *= a
        keep = distance >= 0
        g["D"] = np.bincount(distance[keep], weights=(np.ones(m, kind) @ da.reshape(m, -1)).reshape(n, n)[keep], minlength=len(w["D"])).astype(kind)
        made = room.take("of made", 2 * d, m, n)
        np.matmul(x.reshape(d, m, n).transpose(1, 0, 2), da.transpose(0, 2, 1), out=made[:d].transpose(1, 0, 2))
        np.matmul(scaled.transpose(1, 0, 2), a, out=made[d:].transpose(1, 0, 2))
        made = made.reshape(2 * d, size)
        of_q, of_v = np.split(x @ made.T, 2, axis=1)
        g |= {"Q": of_q @ w["K"], "K": of_q.T @ w["Q"], "V": of_v @ w["P"].T, "P": w["V"].T @ of_v}
        keys = room.take("keys", d, m, n)
        np.matmul(q.transpose(1, 0, 2), da, out=keys.transpose(1, 0, 2))
        du += keys.reshape(d, size)
        du += np.matmul(self._products(), made, out=room.take("dx", d, size))
        rows = rows.reshape(-1)
        g["E"] = np.stack([np.bincount(rows, weights=row, minlength=len(w["E"])) for row in du], axis=1).astype(kind)
        return loss, g

    @staticmethod
    def _exp_columns(z: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
        """As ``_exp``, of columns."""
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.exp(z, out=room.take("exp", *z.shape))
            sums = np.ones(len(z), z.dtype) @ e
        far = np.flatnonzero(~((sums > 1e-20) & (sums < 1e30)))
        if len(far):
            e[:, far] = np.exp(z[:, far] - z[:, far].max(0))
            sums[far] = e[:, far].sum(0)
        return e, sums


class Adam:
    """Adam over all weights laid end to end; they are changed in place."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.names = list(w)
        self.w = np.concatenate([v.reshape(-1) for v in w.values()])
        self.m, self.s, self.g, self.t = (np.zeros_like(self.w) for _ in range(4))
        self.steps, at = 0, 0
        for k, v in list(w.items()):
            w[k] = self.w[at : at + v.size].reshape(v.shape)
            at += v.size

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        kind, now, t = self.w.dtype.type, self.g, self.t
        np.concatenate([g[k].reshape(-1) for k in self.names], out=now)
        self.m *= kind(0.9)
        self.m += np.multiply(now, kind(0.1), out=t)
        self.s *= kind(0.99)
        now *= now
        now *= kind(0.01)
        self.s += now
        np.multiply(self.s, kind(1 / (1 - 0.99**self.steps)), out=t)
        np.sqrt(t, out=t)
        t += kind(1e-8)
        np.divide(self.m, t, out=t)
        t *= kind(rate / (1 - 0.9**self.steps))
        self.w -= t


def score_streams(model: Model, ids: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None, places: np.ndarray | None = None, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Logs of each subword's class among its kind, and of its kind, in many texts laid end to end; 0
    where ``wanted`` (all) is false.

    ``starts``: where each text begins; each text ends with the end id. ``places``: the model's, where
    they are at hand. A text is cut into runs of half a window; a run is scored with the run before it
    as context, so every subword is scored once, from half a window to a whole one of what stands
    before it (less at a text's beginning).
    """
    half = model.config.window // 2
    table = model.places() if places is None else places
    lengths = np.diff(np.concatenate([starts, [len(ids)]]))
    runs = -(-lengths // half)
    base = np.concatenate([[0], np.cumsum(runs)])
    # Texts padded to whole runs, after a run of none; before: rows of what stands before each subword.
    place = np.repeat((base[:-1] + 1) * half - starts, lengths) + np.arange(len(ids))
    total = int(base[-1])
    before = np.full((total + 1) * half, model.classes.rows - 1, dtype=np.int64)
    before[place[1:]] = model.classes.row[ids[:-1]]
    before[(base[:-1] + 1) * half] = model.classes.rows - 1
    first = np.zeros(total, dtype=bool)
    first[base[:-1]] = True
    at = np.arange(len(ids)) if wanted is None else np.flatnonzero(wanted)
    where = place[at] - half
    target = model.classes.of[ids[at]]
    within, kind = np.zeros(len(ids), F32), np.zeros(len(ids), F32)
    room = Room()
    cuts = np.searchsorted(where, np.arange(0, total + at_once, at_once) * half)
    for k, low, high in zip(range(0, total, at_once), cuts, cuts[1:]):
        rows = before[k * half : (k + at_once + 1) * half]
        some = table.take(rows, axis=0, out=room.take("runs", len(rows), table.shape[1]), mode="clip").reshape(-1, half, table.shape[1])
        within[at[low:high]], kind[at[low:high]] = model.class_logs(some, first[k : k + at_once], target[low:high], where[low:high] - k * half, room)
    return within, kind
