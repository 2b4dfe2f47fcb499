"""A gated recurrent language model in numpy with a class-factored output.

Tokens 0 .. n_words-1 are frequent words (the first is the end of a text), in equal classes by rank; every other word falls into
one of n_tails classes by its last bytes. P(word) = P(class | state) * P(word | class): the first factor is a softmax on the state, the
second too for frequent classes, and the class's own add-0.1 unigram for a tail class (with one share for all unseen words).
The biases start at the corpus's log frequencies, so the untrained model is a unigram model of the same words.
"""

from __future__ import annotations

import numpy as np

NAMES = ("table", "u", "b", "class_w", "class_b", "word_w", "word_b")


class Gru:
    def __init__(self, n_words: int, per_class: int, n_tails: int, hidden: int, params: dict | None = None):
        self.n_words, self.per_class, self.n_tails, self.hidden = n_words, per_class, n_tails, hidden
        self.n_classes = n_words // per_class + n_tails
        self.p = params
        self.speed: dict | None = None

    def start(self, word_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        h, n_in = self.hidden, self.n_words + self.n_tails
        flat = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        by_class = word_counts.reshape(-1, self.per_class).astype(np.float64) + 0.1
        self.p = {
            "table": flat(n_in, 3 * h, scale=0.3),
            "u": flat(h, 3 * h, scale=1 / np.sqrt(h)),
            "b": np.concatenate([np.full(h, 1.0), np.zeros(2 * h)]).astype(np.float32),
            "class_w": flat(h, self.n_classes, scale=0.02),
            "class_b": np.log(np.concatenate([by_class.sum(1), tail_counts + 0.1])).astype(np.float32),
            "word_w": flat(len(by_class), h, self.per_class, scale=0.02),
            "word_b": np.log(by_class).astype(np.float32),
        }
        self.p["class_b"] -= self.p["class_b"].max()
        self.p["word_b"] -= self.p["word_b"].max(1, keepdims=True)

    def pack(self, speed: bool = False) -> np.ndarray:
        """All parameters as one vector; with `speed` followed by AdaGrad's sums."""
        return np.concatenate([d[n].ravel() for d in ((self.p, self._sums()) if speed else (self.p,)) for n in NAMES])

    def unpack(self, flat: np.ndarray) -> None:
        h, n = self.hidden, self.n_words // self.per_class
        shapes = {"table": (self.n_words + self.n_tails, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "class_w": (h, self.n_classes), "class_b": (self.n_classes,), "word_w": (n, h, self.per_class), "word_b": (n, self.per_class)}
        parts, at = [], 0
        while at < len(flat):
            parts.append({})
            for k in NAMES:
                size = int(np.prod(shapes[k]))
                parts[-1][k] = flat[at : at + size].reshape(shapes[k]).astype(np.float32)
                at += size
        self.p, self.speed = parts[0], parts[1] if len(parts) > 1 else None

    def _sums(self) -> dict:
        if self.speed is None:
            self.speed = {n: np.full_like(v, 1e-6) for n, v in self.p.items()}
        return self.speed

    def class_of(self, token: np.ndarray) -> np.ndarray:
        n = self.n_words // self.per_class
        return np.where(token < self.n_words, token // self.per_class, n + token - self.n_words)

    def step(self, gates: np.ndarray, cand: np.ndarray, h: np.ndarray):
        """One step for all rows; gates and cand are their inputs' rows of the table, overwritten."""
        k = self.hidden
        gates += h @ self.p["u"][:, : 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5  # the logistic function
        z, r = gates[:, :k], gates[:, k:]
        hun = h @ self.p["u"][:, 2 * k :]
        cand += r * hun
        n = np.tanh(cand, out=cand)
        return n + z * (h - n), z, r, n, hun

    def run(self, inputs: np.ndarray, fresh: np.ndarray | None, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the T steps of (T, B) inputs; fresh marks where a new text starts from the zero state."""
        out = np.empty((*inputs.shape, self.hidden), np.float32)
        rows = self.p["table"] + self.p["b"]
        gates, cand = np.ascontiguousarray(rows[:, : 2 * self.hidden]), np.ascontiguousarray(rows[:, 2 * self.hidden :])
        for t in range(len(inputs)):
            if fresh is not None:
                h = h * ~fresh[t][:, None]
            nxt, *rest = self.step(gates[inputs[t]], cand[inputs[t]], h)
            if keep is not None:
                keep.append((h, *rest))
            out[t] = h = nxt
        return out

    def losses(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target (a tail word: of its class); with grads also the gradient of the loss for the states."""
        e = states @ self.p["class_w"]
        e += self.p["class_b"]
        cls, rows = self.class_of(targets), np.arange(len(targets))
        out = e[rows, cls]
        np.exp(e, out=e)  # states lie in -1 .. 1 and biases at or below 0: no overflow
        total = e @ np.ones(e.shape[1], np.float32)
        out -= np.log(total)
        back = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["class_w"] = states.T @ e
            grads["class_b"] = e.sum(0)
            grads["word_w"], grads["word_b"] = np.zeros_like(self.p["word_w"]), np.zeros_like(self.p["word_b"])
            back = e @ self.p["class_w"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.n_words // self.per_class + 1))
        for c in range(len(cuts) - 1):
            which = order[cuts[c] : cuts[c + 1]]
            if not len(which):
                continue
            own = states[which]
            e = own @ self.p["word_w"][c]
            e += self.p["word_b"][c]
            word, rows = targets[which] - c * self.per_class, np.arange(len(which))
            out[which] += e[rows, word]
            np.exp(e, out=e)
            total = e @ np.ones(e.shape[1], np.float32)
            out[which] -= np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[rows, word] -= 1
                grads["word_w"][c] = own.T @ e
                grads["word_b"][c] = e.sum(0)
                back[which] += e @ self.p["word_w"][c].T
        return out, back

    def gradient(self, inputs, fresh, targets, h0, real=None):
        """Truncated backpropagation through one (T, B) window: gradients, last state, mean log probability. Where `real` is given, only the
        targets that it marks count."""
        keep, grads, k = [], {}, self.hidden
        states = self.run(inputs, fresh, h0, keep)
        if real is None or real.all():
            logp, back = self.losses(states.reshape(-1, k), targets.ravel(), grads)
        else:
            which = np.flatnonzero(real.ravel())
            logp, some = self.losses(states.reshape(-1, k)[which], targets.ravel()[which], grads)
            back = np.zeros((targets.size, k), some.dtype)
            back[which] = some
        back = back.reshape(states.shape)
        d_in = np.empty((*inputs.shape, 3 * k), np.float32)
        d_hu = np.empty_like(d_in)
        before = np.empty_like(states)
        dh = np.zeros_like(h0)
        ut = np.ascontiguousarray(self.p["u"].T)
        for t in range(len(inputs) - 1, -1, -1):
            h, z, r, n, hun = keep[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            d_in[t, :, :k], d_in[t, :, k : 2 * k], d_in[t, :, 2 * k :] = dz, dr, dn
            d_hu[t, :, : 2 * k] = d_in[t, :, : 2 * k]
            d_hu[t, :, 2 * k :] = dn * r
            before[t] = h
            dh = dh * z + d_hu[t] @ ut
            if fresh is not None:
                dh *= ~fresh[t][:, None]
        grads["u"] = before.reshape(-1, k).T @ d_hu.reshape(-1, 3 * k)
        flat = d_in.reshape(-1, 3 * k)
        grads["b"] = flat.sum(0)
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        seen, first = np.unique(inputs.ravel()[order], return_index=True)
        grads["table"] = (seen, np.add.reduceat(flat[order], first, axis=0))
        n = len(logp)
        return {g: (v[0], v[1] / n) if g == "table" else v / n for g, v in grads.items()}, states[-1], float(logp.mean())

    def train(self, tokens: np.ndarray, fresh: np.ndarray, window: int, rate: float = 0.05) -> float:
        """One pass over a stream of texts laid side by side in parallel lanes; the state is carried from window to window.
        Every token is a target once: the lanes are filled up behind the last one, with steps that do not count. A lane that starts inside a text starts with
        that text's last token and no state. AdaGrad's sums go on from what the model holds."""
        if not len(tokens):
            return 0.0
        lanes = int(min(256, max(4, len(tokens) // 2048)))
        length = -(-len(tokens) // lanes)
        filled = lambda v: np.concatenate([v, np.zeros(lanes * length - len(v), v.dtype)]).reshape(lanes, length).T
        grid, start, real = filled(tokens), filled(fresh).copy(), filled(np.ones(len(tokens), bool))
        # the input at a step is the token before; a text's first input is the end of the one before
        inputs = filled(np.concatenate([[0], tokens[:-1]]))
        inputs = np.where(start, 0, inputs)
        h = np.zeros((lanes, self.hidden), np.float32)
        speed = self._sums()
        logp = []
        for a in range(0, length, window):
            g, h, lp = self.gradient(inputs[a : a + window], start[a : a + window], grid[a : a + window], h, real[a : a + window])
            logp.append(lp)
            for n, d in g.items():
                if n == "table":
                    rows, d = d
                    speed[n][rows] += d * d
                    self.p[n][rows] -= rate * d / np.sqrt(speed[n][rows])
                else:
                    speed[n] += d * d
                    self.p[n] -= rate * d / np.sqrt(speed[n])
        return float(np.mean(logp))

    def score(self, tokens: np.ndarray, offsets: np.ndarray, window: int = 32) -> np.ndarray:
        """Natural log probability of each token; texts advance together, longest first, each with its own state from its first
        token to its last."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        ends = size[order]
        out = np.zeros(len(tokens), np.float64)
        h = np.zeros((len(order), self.hidden), np.float32)
        at, longest = 0, int(ends[0]) if len(ends) else 0
        while at < longest:
            live = int(np.searchsorted(-ends, -at, side="left"))
            until = min(at + window, longest)
            steps = np.arange(at, until)
            begin = offsets[:-1][order[:live]]
            place = begin[None, :] + steps[:, None]
            ok = steps[:, None] < ends[None, :live]
            place = np.where(ok, place, begin[None, :])
            inputs = np.where((steps > 0)[:, None], tokens[np.maximum(place - 1, 0)], 0)
            states = self.run(inputs, None, h[:live])
            h[:live] = states[-1]
            which = np.flatnonzero(ok.ravel())
            out[place.ravel()[which]] = self.losses(states.reshape(-1, self.hidden)[which], tokens[place.ravel()[which]])[0]
            at = until
        return out
