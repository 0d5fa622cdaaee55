"""A gated recurrent language model with a class-factored output, in numpy.

The next word's probability is that of its class times that of the word within
the class; both depend on the state. Classes are runs of words by falling
count with about equal sums of the counts' square roots, so frequent words have
small classes. Words outside the model's vocabulary share the last class, inside
which probabilities are fixed by the corpus counts. Output biases start at the
counts' logarithms: before training this is the unigram model.

Training is truncated backpropagation through time over many streams at once;
the state is carried from window to window and reset where a text ends.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
CLASSES = 32
# Words the model knows, the end of a text among them.
WORDS = 2_048
STREAMS, WINDOW = 512, 24
RATE = 0.08
CLIP = 5.0
END = 0


def class_starts(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Where the classes of words in falling order of count begin, and the end."""
    weight = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], cuts[cuts < len(counts)], [len(counts)]]))


@dataclass
class Gru:
    """``starts``: class borders over the words; the other arrays are learned."""

    starts: np.ndarray
    inputs: np.ndarray         # word (and one for unknown, one for the start) x 3 gates
    recurrent: np.ndarray      # hidden x 3 gates
    class_out: np.ndarray      # class (and one for other words) x hidden
    class_bias: np.ndarray
    word_out: np.ndarray       # word x hidden
    word_bias: np.ndarray

    LEARNED = ("inputs", "recurrent", "class_out", "class_bias", "word_out", "word_bias")

    def __post_init__(self) -> None:
        self.class_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        # Few classes: small integers are sorted by radix.
        self.class_of = np.concatenate([self.class_of, [len(self.starts) - 1]]).astype(np.min_scalar_type(len(self.starts)))

    @property
    def words(self) -> int:
        return len(self.word_out)

    @classmethod
    def untrained(cls, counts: np.ndarray, other: int, hidden: int = HIDDEN, seed: int = 5) -> Gru:
        """``counts`` of the words, the end first among them, and of all other words together."""
        rng = np.random.default_rng(seed)
        starts = class_starts(counts)
        mass = np.add.reduceat(counts, starts[:-1]).astype(np.float64)
        bias = np.log(np.concatenate([mass, [max(other, 1)]]) / (mass.sum() + max(other, 1)))
        inside = np.log(counts / np.repeat(mass, np.diff(starts)))
        return cls(starts, rng.normal(0, 0.1, (len(counts) + 2, 3 * hidden)).astype(np.float32),
                   rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
                   np.zeros((len(starts), hidden), np.float32), bias.astype(np.float32),
                   np.zeros((len(counts), hidden), np.float32), inside.astype(np.float32))

    def pack(self) -> bytes:
        out = io.BytesIO()
        for name in self.LEARNED:
            out.write(np.ascontiguousarray(getattr(self, name), dtype="<f4").tobytes())
        return out.getvalue()

    def unpack(self, data: bytes | np.ndarray) -> Gru:
        """A model of this shape with the given numbers."""
        flat, at, parts = np.frombuffer(data, "<f4") if isinstance(data, bytes) else data, 0, []
        for name in self.LEARNED:
            shape = getattr(self, name).shape
            size = int(np.prod(shape))
            parts.append(flat[at:at + size].reshape(shape).astype(np.float32))
            at += size
        return Gru(self.starts, *parts)


def _step(model: Gru, words: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for all columns of the state (hidden x text): the new state and what backpropagation needs.

    A gate's numbers lie side by side in this layout, so every operation runs through one piece of memory.
    """
    h = state.shape[0]
    fed = model.inputs.take(words, axis=0).T
    from_state = model.recurrent.T @ state
    gates = from_state[:2 * h] + fed[:2 * h]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1.0
    np.reciprocal(gates, out=gates)
    keep, reset = gates[:h], gates[h:]
    new = reset * from_state[2 * h:]
    new += fed[2 * h:]
    np.tanh(new, out=new)
    out = state - new
    out *= keep
    out += new
    return out, keep, reset, new, from_state[2 * h:]


def _log_softmax_of(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the entry ``at`` of each column; the probabilities replace the logits."""
    logits -= logits.max(axis=0)
    picked = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    return picked - np.log(total), np.divide(logits, total, out=logits)


def _score_of(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the entry ``at`` of each column."""
    logits -= logits.max(axis=0)
    picked = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    return picked - np.log(logits.sum(axis=0))


def output_scores(model: Gru, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target's class, and of the word in it unless it is another word; a state is a column."""
    cls = model.class_of[targets]
    scores = _score_of(model.class_out @ states + model.class_bias[:, None], cls)
    order = np.argsort(cls, kind="stable")
    borders = np.searchsorted(cls[order], np.arange(len(model.starts)))
    for c in range(len(model.starts) - 1):
        rows = order[borders[c]:borders[c + 1]]
        if len(rows):
            a, b = model.starts[c], model.starts[c + 1]
            logits = model.word_out[a:b] @ states.take(rows, axis=1) + model.word_bias[a:b, None]
            scores[rows] += _score_of(logits, targets[rows] - a)
    return scores


def score_texts(model: Gru, texts: Sequence[np.ndarray], together: int = 1 << 22, rows: int = 2_048,
                flush: int = 1 << 16) -> np.ndarray:
    """Natural log-probability of whole texts (word numbers, the end last).

    Texts of similar length step together, at most ``rows`` of them and
    ``together`` words; the state goes on until a text's end. Outputs are
    scored whenever ``flush`` states have gathered, so memory is bounded for
    texts of any length.
    """
    lengths = np.array([len(t) for t in texts])
    out = np.zeros(len(texts))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    hidden = model.recurrent.shape[0]
    while len(order):
        n = max(1, min(len(order), int(together // lengths[order[0]]), rows))
        group, order = order[:n], order[n:]
        size = lengths[group]
        steps = int(size[0])
        # Step by step, so that one step's words lie side by side.
        padded = np.zeros((steps, n), dtype=np.int32)
        for column, i in enumerate(group):
            padded[:len(texts[i]), column] = texts[i]
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        state = np.zeros((hidden, n), dtype=np.float32)
        states, waiting, first = [], 0, 0
        for t in range(steps):
            r = running[t]
            before = padded[t - 1, :r] if t else np.full(r, model.words + 1)
            state = _step(model, before, state[:, :r])[0]
            states.append(state)
            waiting += r
            if waiting >= flush or t + 1 == steps:
                targets = [padded[u, :running[u]] for u in range(first, t + 1)]
                scores = output_scores(model, np.concatenate(states, axis=1), np.concatenate(targets))
                at = np.concatenate([np.arange(k) for k in running[first:t + 1]])
                out[group] += np.bincount(at, scores, n)
                states, waiting, first = [], 0, t + 1
    return out


class Trainer:
    """Adagrad over windows of many streams."""

    def __init__(self, model: Gru, rate: float = RATE):
        self.model, self.rate = model, rate
        self.sums = {name: np.full_like(getattr(model, name), 0.1) for name in model.LEARNED}
        self.loss = 0.0
        self.words = 0

    def _move(self, name: str, gradient: np.ndarray, rows: slice | np.ndarray = slice(None)) -> None:
        seen = self.sums[name][rows] + gradient * gradient
        self.sums[name][rows] = seen
        getattr(self.model, name)[rows] -= self.rate * gradient / np.sqrt(seen)

    def learn(self, words: np.ndarray, streams: int = STREAMS, window: int = WINDOW) -> None:
        """Go once over texts laid end to end (word numbers, each text closed by the end)."""
        streams = max(1, min(streams, len(words) // window))
        length = -(-len(words) // streams)
        rows = np.full(streams * length, -1, dtype=np.int64)
        rows[:len(words)] = words
        rows = rows.reshape(streams, length)
        state = np.zeros((self.model.recurrent.shape[0], streams), dtype=np.float32)
        before = np.full(streams, END)
        for low in range(0, length, window):
            targets = rows[:, low:low + window].T
            inputs = np.concatenate([before[None], targets[:-1]])
            state = self._window(np.where(inputs == END, self.model.words + 1, inputs), targets, inputs == END, state)
            before = targets[-1]

    def _window(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Learn from one window (step x stream); streams that have ended hold -1."""
        model = self.model
        steps, n = targets.shape
        inputs = np.where(inputs < 0, 0, inputs)
        kept, states = [], np.empty((len(state), steps, n), dtype=np.float32)
        for t in range(steps):
            state = np.where(fresh[t], np.float32(0), state)
            after, *rest = _step(model, inputs[t], state)
            kept.append((state, *rest))
            state = states[:, t] = after
        live = np.flatnonzero(targets.ravel() >= 0)
        if not len(live):
            return state
        flat = states.reshape(len(state), steps * n)
        if len(live) == steps * n:
            grad = self._output(flat, targets.ravel())
        else:
            grad = np.zeros_like(flat)
            grad[:, live] = self._output(flat.take(live, axis=1), targets.ravel()[live])
        self._through_time(inputs, fresh, kept, grad.reshape(states.shape))
        return state

    def _output(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Learn the output layers; the loss's gradient with respect to the states, a column each."""
        model = self.model
        # Gradients are of the loss per stream and window, not per word.
        scale = np.float32(1.0 / STREAMS)
        cls = model.class_of[targets]
        score, p = _log_softmax_of(model.class_out @ states + model.class_bias[:, None], cls)
        self.loss -= float(score.sum())
        p[cls, np.arange(len(cls))] -= 1.0
        grad = model.class_out.T @ p
        class_grad, bias_grad = p @ states.T, p.sum(axis=1)
        order = np.argsort(cls, kind="stable")
        borders = np.searchsorted(cls[order], np.arange(len(model.starts)))
        for c in range(len(model.starts) - 1):
            rows = order[borders[c]:borders[c + 1]]
            if len(rows):
                at = slice(model.starts[c], model.starts[c + 1])
                mine = states.take(rows, axis=1)
                inside = targets[rows] - model.starts[c]
                score, q = _log_softmax_of(model.word_out[at] @ mine + model.word_bias[at, None], inside)
                self.loss -= float(score.sum())
                q[inside, np.arange(len(rows))] -= 1.0
                grad[:, rows] += model.word_out[at].T @ q
                self._move("word_out", q @ mine.T * scale, at)
                self._move("word_bias", q.sum(axis=1) * scale, at)
        self._move("class_out", class_grad * scale)
        self._move("class_bias", bias_grad * scale)
        self.words += len(targets)
        return grad

    def _through_time(self, inputs: np.ndarray, fresh: np.ndarray, kept: list, grad: np.ndarray) -> None:
        model = self.model
        h, steps, n = grad.shape
        scale = np.float32(1.0 / STREAMS)
        fed = np.empty((steps, n, 3 * h), dtype=np.float32)
        recurrent = np.zeros_like(model.recurrent)
        back = np.zeros((h, n), dtype=np.float32)
        through = np.empty((3 * h, n), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            previous, keep, reset, new, from_state = kept[t]
            d = grad[:, t] + back
            d_new = d * (1 - keep) * (1 - new * new)
            through[:h] = d * (previous - new) * keep * (1 - keep)
            through[h:2 * h] = d_new * from_state * reset * (1 - reset)
            through[2 * h:] = d_new
            fed[t] = through.T
            through[2 * h:] *= reset
            recurrent += previous @ through.T
            back = d * keep + model.recurrent @ through
            back[:, fresh[t]] = 0.0
        np.clip(recurrent, -CLIP * STREAMS, CLIP * STREAMS, out=recurrent)
        flat_inputs, flat = inputs.ravel(), fed.reshape(steps * n, -1)
        order = np.argsort(flat_inputs.astype(np.min_scalar_type(len(model.inputs))), kind="stable")
        seen, first = np.unique(flat_inputs[order], return_index=True)
        self._move("inputs", np.add.reduceat(flat[order], first, axis=0) * scale, seen)
        self._move("recurrent", recurrent * scale)
