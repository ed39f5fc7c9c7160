"""A small gated recurrent language model in NumPy, with a class-factored output.

Tokens 0 to n-1 are ordered by class; the output probability of a token is that of its class, by
softmax, times that of the token within its class. The latter comes from a binary tree over the
tokens of the class, with halves of about equal counts: a token costs about as many steps as its
information has bits, so the vocabulary can be large. Weights of the output start at the logarithms of the counts, so
an untrained model is the count model. Training is truncated backpropagation: the state is carried
from one window to the next, the gradient is not.
"""

from __future__ import annotations

import numpy as np


#: Rows that are held against all classes at a time.
ROWS_AT_ONCE = 8192
#: Texts that are scored side by side: what a window of them takes stays in a core's cache.
TEXTS_AT_ONCE = 256


class Tree:
    """Binary trees over the tokens of each class. A node cuts a range of tokens; its number is the
    first token behind the cut, so no two nodes have the same."""

    def __init__(self, weights: np.ndarray, class_of: np.ndarray):
        n = len(weights)
        total = np.concatenate([[0.0], np.cumsum(weights)])
        #: Logarithm of the weight behind a cut over the one before it.
        self.odds = np.zeros(n)
        edges = [0, *(np.flatnonzero(np.diff(class_of)) + 1).tolist(), n]
        ranges = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]
        nodes, owners, sides = [], [], []
        while ranges:
            low, high = np.array(ranges).T
            middle = (total[low] + total[high]) / 2
            at = np.searchsorted(total, middle)
            at -= middle - total[at - 1] < total[at] - middle
            at = np.clip(at, low + 1, high - 1)
            self.odds[at] = np.log((total[high] - total[at]) / (total[at] - total[low]))
            sizes = high - low
            first = np.cumsum(sizes) - sizes
            own = np.arange(sizes.sum()) + np.repeat(low - first, sizes)
            owners.append(own)
            nodes.append(np.repeat(at, sizes))
            sides.append(own >= nodes[-1])
            both = np.stack([low, at, high], 1).tolist()
            ranges = [x for a, m, b in both for x in ((a, m), (m, b)) if x[1] - x[0] > 1]
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        #: Nodes on the way to a token, from `first[token]` on, and whether it is behind the cut.
        self.nodes = np.concatenate([*nodes, np.zeros(0, np.int64)])[order]
        self.behind = np.concatenate([*sides, np.zeros(0, bool)])[order]
        self.steps = np.bincount(owner, minlength=n)
        self.first = np.cumsum(self.steps) - self.steps

    def ways(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of a token in `tokens`, the node and the side, for each step to each token."""
        steps = self.steps[tokens]
        places = np.repeat(np.arange(len(tokens)), steps)
        at = np.arange(len(places)) + np.repeat(
            self.first[tokens] - (np.cumsum(steps) - steps), steps
        )
        return places, self.nodes[at], self.behind[at]


class Gru:
    """Parameters: `W` token to gates, `U` state to gates, `b`, classes `C`, `c`, tree `O`, `o`."""

    NAMES = ("W", "U", "b", "C", "c", "O", "o")
    #: Of these, a window moves the rows of its own tokens.
    SPARSE = ("W", "O", "o")

    def __init__(self, class_of: np.ndarray, params: dict[str, np.ndarray], tree: Tree):
        self.class_of, self.tree = class_of, tree
        self.__dict__.update(params)
        self.hidden = self.U.shape[0]

    @classmethod
    def fresh(cls, counts: np.ndarray, class_of: np.ndarray, hidden: int, seed: int) -> Gru:
        rng = np.random.default_rng(seed)
        n, classes = len(counts), class_of[-1] + 1
        shares = np.log((counts + 0.5) / (counts.sum() + 0.5 * n))
        per_class = np.bincount(class_of, np.exp(shares), classes)
        tree = Tree(np.exp(shares), class_of)
        params = {
            "W": rng.normal(0, 0.3, (n, 3 * hidden)),
            "U": rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "b": np.zeros(3 * hidden),
            "C": np.zeros((hidden, classes)),
            "c": np.log(per_class),
            "O": np.zeros((n, hidden)),
            "o": tree.odds,
        }
        return cls(class_of, {k: v.astype(np.float32) for k, v in params.items()}, tree)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def with_flat(self, flat: np.ndarray) -> Gru:
        params, at = {}, 0
        for k in self.NAMES:
            old = getattr(self, k)
            params[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Gru(self.class_of, params, self.tree)

    # -- forward ----------------------------------------------------------------------------------

    def states(self, inputs: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before each step of a window (rows, steps), the last state, what backward needs.

        Inside, rows lie side by side, so that each gate of a step is one run of memory.
        """
        h, rows, steps = self.hidden, *inputs.shape
        gates = np.ascontiguousarray(self.W.take(inputs.T, axis=0).transpose(0, 2, 1))
        gates += self.b[:, None]
        across, state = np.ascontiguousarray(self.U.T), np.ascontiguousarray(state.T)
        before = np.empty((steps, h, rows), gates.dtype)
        inner = np.empty_like(before) if keep else None
        for t in range(steps):
            before[t] = state
            x, u = gates[t], across @ state
            zr, new = x[: 2 * h], x[2 * h :]
            zr += u[: 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            if keep:
                inner[t] = u[2 * h :]
            new += np.multiply(zr[h:], u[2 * h :], out=u[:h])
            np.tanh(new, out=new)
            state = state - new
            state *= zr[:h]
            state += new
        return before.transpose(0, 2, 1), state.T, (gates, inner) if keep else None

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target after its state."""
        out = np.empty(len(targets))
        for a in range(0, len(targets), ROWS_AT_ONCE):
            own, wanted = states[a : a + ROWS_AT_ONCE], targets[a : a + ROWS_AT_ONCE]
            logits = self.C.T @ own.T + self.c[:, None]
            found = logits[self.class_of[wanted], np.arange(len(wanted))] - _log_sum(logits)
            places, nodes, behind = self.tree.ways(wanted)
            odds = np.einsum("ij,ij->i", own.take(places, axis=0), self.O.take(nodes, axis=0)) + self.o[nodes]
            steps = _log_sigmoid(np.where(behind, odds, -odds))
            out[a : a + ROWS_AT_ONCE] = found + np.bincount(places, steps, len(wanted))
        return out

    def score(self, texts: list[np.ndarray], start: int, window: int) -> np.ndarray:
        """Log-likelihood of each text as a whole; the state goes on from window to window."""
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        total = np.zeros(len(texts))
        begins = np.cumsum(lens) - lens
        flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
        for a in range(0, len(order), TEXTS_AT_ONCE):  # of about equal lengths
            rows = order[a : a + TEXTS_AT_ONCE]
            state = np.zeros((len(rows), self.hidden), np.float32)
            longest = int(lens[rows].max())
            for at in range(0, longest, window):
                rows = rows[: int((lens[rows] > at).sum())]
                width = min(window, longest - at)
                places = begins[rows, None] + at + np.arange(width)
                valid = at + np.arange(width) < lens[rows, None]
                targets = flat[np.where(valid, places, 0)]
                inputs = np.empty_like(targets)
                inputs[:, 1:] = targets[:, :-1]
                inputs[:, 0] = start if at == 0 else flat[begins[rows] + at - 1]
                before, state, _ = self.states(inputs, state[: len(rows)])
                fits = valid.T.ravel()
                found = np.zeros(fits.size)
                found[fits] = self.log_probs(
                    before.reshape(-1, self.hidden)[fits], targets.T.ravel()[fits]
                )
                total[rows] += found.reshape(width, -1).sum(0)
        return total

    # -- training ---------------------------------------------------------------------------------

    def gradient(self, inputs, targets, valid, state):
        """Gradients of the mean loss of a window, the last state, and the loss."""
        grads, last, loss = self._gradient(inputs, targets, valid, state)
        for k in self.SPARSE:
            at, rows = grads[k]
            grads[k] = np.zeros_like(getattr(self, k))
            grads[k][at] = rows
        return grads, last, loss

    def _gradient(self, inputs, targets, valid, state, with_loss: bool = True):
        """The same, with gradients of `SPARSE` parameters as the rows that are not 0; the loss is left
        out at wish."""
        h, (rows, steps) = self.hidden, inputs.shape
        before, last, (gates, inner) = self.states(inputs, state, keep=True)
        fits = valid.T.ravel()
        flat = before.reshape(-1, h)[fits]
        wanted = targets.T.ravel()[fits]
        n = max(1, len(wanted))
        grads = {}
        # Output: classes, then the ways to the tokens in their trees.
        probs = self.C.T @ flat.T
        probs += self.c[:, None]
        probs -= probs.max(0)
        np.exp(probs, out=probs)
        probs /= probs.sum(0)
        at = np.arange(len(wanted))
        loss = -np.log(probs[self.class_of[wanted], at] + 1e-30).sum() if with_loss else 0.0
        probs[self.class_of[wanted], at] -= 1
        grads["C"], grads["c"] = flat.T @ probs.T / n, probs.sum(1) / n
        back = probs.T @ self.C.T
        grads["O"], grads["o"], more = self._down_the_trees(flat, wanted, back, n, with_loss)
        loss += more
        to_before = np.zeros((steps * rows, h), back.dtype)
        to_before[fits] = back / n
        to_before = np.ascontiguousarray(to_before.reshape(steps, rows, h).transpose(0, 2, 1))
        # States, last step first: what a gradient on the state gives to new, z, r and u.
        before = before.transpose(0, 2, 1)
        z, r, new = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        to_new = (1 - z) * (1 - new * new)
        to_z = (before - new) * z * (1 - z)
        to_r = inner * r * (1 - r)
        gate_grads = np.empty((steps, 3 * h, rows), back.dtype)
        u_grads = np.empty((steps, 3 * h, rows), back.dtype)
        d_state = np.zeros((h, rows), back.dtype)
        for t in range(steps - 1, -1, -1):
            d, du = gate_grads[t], u_grads[t]
            d_new = np.multiply(d_state, to_new[t], out=d[2 * h :])
            np.multiply(d_state, to_z[t], out=d[:h])
            np.multiply(d_new, to_r[t], out=d[h : 2 * h])
            du[: 2 * h] = d[: 2 * h]
            np.multiply(d_new, r[t], out=du[2 * h :])
            d_state *= z[t]
            d_state += self.U @ du
            d_state += to_before[t]
        grads["U"] = np.matmul(before, u_grads.transpose(0, 2, 1)).sum(0)
        flat_grads = gate_grads.transpose(0, 2, 1).reshape(-1, 3 * h)
        grads["W"] = _by_key(inputs.T.ravel(), flat_grads)
        grads["b"] = gate_grads.sum((0, 2))
        return grads, last, loss / n

    def _down_the_trees(self, flat, wanted, back, n: int, with_loss: bool):
        """Gradients of `O` and `o` as rows that are not 0, and the loss; adds to `back`.

        Tokens in order, all of them one step down at a time: a node's tokens are then neighbours.
        """
        tree, loss = self.tree, 0.0
        places = _order(wanted)
        steps = tree.steps.take(wanted.take(places))
        cuts, rows, odds_rows = [np.zeros(0, np.int64)], [self.O[:0]], [self.o[:0]]
        own, at, depth = flat.take(places, axis=0), tree.first.take(wanted.take(places)), 0
        found = np.zeros_like(own)
        while True:
            on = steps > depth
            if not on.all():
                done, on = np.flatnonzero(~on), np.flatnonzero(on)
                if depth:
                    back[places.take(done)] += found.take(done, axis=0)
                places, steps, at = places.take(on), steps.take(on), at.take(on)
                own, found = own.take(on, axis=0), found.take(on, axis=0)
            if not len(places):
                break
            nodes, behind = tree.nodes.take(at), tree.behind.take(at)
            weights = self.O.take(nodes, axis=0)
            odds = np.einsum("ij,ij->i", own, weights) + self.o.take(nodes)
            if with_loss:
                loss -= _log_sigmoid(np.where(behind, odds, -odds)).sum()
            off = 0.5 + 0.5 * np.tanh(0.5 * odds) - behind
            weights *= off[:, None]
            found += weights
            off /= n
            first = _first(nodes)
            cuts.append(nodes.take(first))
            np.multiply(own, off[:, None], out=weights)
            rows.append(np.add.reduceat(weights, first))
            odds_rows.append(np.add.reduceat(off, first))
            at, depth = at + 1, depth + 1
        cut = np.concatenate(cuts)
        return (cut, np.concatenate(rows)), (cut, np.concatenate(odds_rows)), loss

    def train(
        self, texts: list[np.ndarray], start: int, window: int, rows: int, rate: float
    ) -> Gru:
        """One pass over the texts, `rows` at a time, by Adam."""
        adam = Adam(self, rate)
        adam.train(texts, start, window, rows)
        adam.finish(start, window)
        return self


class Adam:
    """Steps of a model; a row of a sparse parameter moves when it has a gradient.

    Texts lie in lanes, side by side. A lane whose text has ended takes the next one with the next
    window, so a window is full however long the texts are. Lanes and averages go on from one call
    of `train` to the next, so texts can come in blocks; `finish` goes on to the end of all lanes. The
    last windows have few lanes, and their steps are as much shorter: a text counts by its tokens.
    """

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.first = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
        self.second = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
        #: Texts of the lanes, where each goes on, and the states there.
        self.lanes: list[np.ndarray] = []
        self.at = np.zeros(0, np.int64)
        self.state = np.zeros((0, model.hidden), np.float32)
        self.full = 1  # tokens of the fullest window so far

    def train(self, texts: list[np.ndarray], start: int, window: int, rows: int) -> None:
        """All windows that have `rows` lanes; the longest texts begin first."""
        waiting = sorted((t for t in texts if len(t)), key=len)
        while waiting:
            new = max(0, min(rows - len(self.lanes), len(waiting)))
            self.lanes += [waiting.pop() for _ in range(new)]
            self.at = np.concatenate([self.at, np.zeros(new, np.int64)])
            self.state = np.concatenate([self.state, np.zeros((new, self.model.hidden), np.float32)])
            if len(self.lanes) >= rows:
                self._window(start, window)

    def finish(self, start: int, window: int) -> None:
        while self.lanes:
            self._window(start, window)

    def _window(self, start: int, window: int) -> None:
        left = np.array([len(t) for t in self.lanes]) - self.at
        width = min(window, int(left.max()))
        targets = np.zeros((len(left), width), np.int32)
        inputs = np.empty_like(targets)
        inputs[:, 0] = start
        for i, (text, at) in enumerate(zip(self.lanes, self.at.tolist())):
            part = text[at : at + width]
            targets[i, : len(part)] = part
            if at:
                inputs[i, 0] = text[at - 1]
        inputs[:, 1:] = targets[:, :-1]
        valid = np.arange(width) < left[:, None]
        grads, state, _ = self.model._gradient(inputs, targets, valid, self.state, False)
        self.full = max(self.full, int(valid.sum()))
        self.move(grads, valid.sum() / self.full)
        on = left > width
        self.lanes = [text for text, more in zip(self.lanes, on.tolist()) if more]
        self.at, self.state = self.at[on] + width, state[on]

    def move(self, grads: dict, share: float = 1.0) -> None:
        """One step, shorter for a window that is not full."""
        self.step += 1
        size = share * self.rate / (1 - 0.9**self.step)
        scale = 1 / (1 - 0.99**self.step)
        for k, g in grads.items():
            param, first, second = getattr(self.model, k), self.first[k], self.second[k]
            if k in self.model.SPARSE:
                at, g = g
                first, second = first.take(at, axis=0), second.take(at, axis=0)
            g = np.clip(g, -1, 1, out=g)
            first *= 0.9
            first += 0.1 * g
            second *= 0.99
            g *= g
            g *= 0.01
            second += g
            np.multiply(second, scale, out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(first, g, out=g)
            g *= size
            if k in self.model.SPARSE:
                param[at] = np.subtract(param.take(at, axis=0), g, out=g)
                self.first[k][at], self.second[k][at] = first, second
            else:
                param -= g


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Of each column."""
    most = logits.max(0)
    return most + np.log(np.exp(logits - most).sum(0))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.minimum(x, 0) - np.log1p(np.exp(-np.abs(x)))


def _order(keys: np.ndarray) -> np.ndarray:
    small = len(keys) and keys.max() < 1 << 16  # 16 bits are sorted by digits, which is faster
    return np.argsort(keys.astype(np.uint16) if small else keys, kind="stable")


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _by_key(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of the rows of each."""
    order = _order(keys)
    keys = keys.take(order)
    first = _first(keys)
    return keys.take(first), np.add.reduceat(rows.take(order, axis=0), first)


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of neighbours in the order given, of about equal counts; none is empty."""
    share = np.cumsum(counts) - counts / 2
    wanted = np.minimum((share / counts.sum() * classes).astype(np.int64), classes - 1)
    return np.unique(wanted, return_inverse=True)[1]
