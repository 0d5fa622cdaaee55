"""A linear-chain conditional random field over the words of a text.

Every word has a label; its score is the sum of the weights of its affixes,
character n-grams and itself (the lexicon), hashed into a fixed number of
buckets, and neighbouring labels add a learned transition. Text in scripts
without spaces, and words above ``LONGEST_WORD`` letters, are cut at
punctuation and changes of script and then into pieces of a word's usual
length, each with a label of its own; no letter is left out. Forward-backward
gives each word's label probabilities. Numpy only; sequences are handled many
at a time, a step of all of them at once.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 16
LONGEST_AFFIX = 4
LONGEST_WORD = 48
# Scripts written without spaces and the letters of a piece in each: Han, kana, and Thai, Lao, Tibetan, Burmese, Khmer
# and the like. Longer words of other scripts go by the last number.
SCRIPTS = ["\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", "\u3041-\u30ff\u31f0-\u31ff\uff66-\uff9f",
           "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aad\ua9e0-\ua9ff\uaa60-\uaadf"]
PIECES = (2, 3, 5, 8)
UNSPACED = re.compile(f"[{''.join(SCRIPTS)}]")
# Pieces reach so far into the next one that every n-gram is inside of one.
OVERLAP = 2


def letters_of(word: str) -> str:
    """The word without leading and trailing non-letters, lower-cased; empty if no letter is left."""
    if not word.isalpha():
        inside = [i for i, c in enumerate(word) if c.isalpha()]
        if not inside:
            return ""
        word = word[inside[0]:inside[-1] + 1]
    return word.lower()


@functools.lru_cache(maxsize=1 << 16)
def _script(letter: str) -> int:
    """Place in ``PIECES``; -1 for what is neither letter nor mark."""
    if unicodedata.category(letter)[0] not in "LM":
        return -1
    return next((i for i, ranges in enumerate(SCRIPTS) if re.match(f"[{ranges}]", letter)), len(SCRIPTS))


def is_one(word: str) -> bool:
    """Whether a word between spaces has a single label."""
    return len(word) <= LONGEST_WORD and not UNSPACED.search(word)


def tokens_of(word: str) -> list[str]:
    """What of a word between spaces has labels: its letters, or the pieces of an unspaced text; none without letters."""
    if is_one(word):
        core = letters_of(word)
        return [core] if core else []
    out = []
    for script, run in itertools.groupby(word, _script):
        if script >= 0:
            run = "".join(run).lower()
            if script == len(SCRIPTS) and len(run) <= LONGEST_WORD:
                out.append(run)
            else:
                step = PIECES[script]
                out += [run[i:i + step + OVERLAP] for i in range(0, len(run), step)]
    return [piece for piece in out if any(map(str.isalpha, piece))]


def features_of(core: str) -> list[int]:
    """Buckets of the affixes, the 2- and 3-grams and the word itself."""
    marked = f"^{core}$"
    names = [f"w{core}"]
    names += [f"p{core[:n]}" for n in range(1, LONGEST_AFFIX + 1)]
    names += [f"s{core[-n:]}" for n in range(1, LONGEST_AFFIX + 1)]
    names += [f"g{marked[i:i + n]}" for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names]


class _Buckets(dict):
    """Bucket of each name with one prefix, remembered."""

    def __init__(self, prefix: str):
        super().__init__()
        self.prefix = prefix

    def __missing__(self, name: str) -> int:
        bucket = self[name] = zlib.crc32(f"{self.prefix}{name}".encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


class Features:
    """``features_of`` for many words: affixes and n-grams recur, so their buckets are remembered, up to ``CACHED`` of them."""

    CACHED = 200_000

    def __init__(self) -> None:
        self.whole, self.heads, self.tails, self.grams = (_Buckets(p) for p in "wpsg")

    def of(self, core: str) -> list[int]:
        marked = f"^{core}$"
        heads, tails, grams = self.heads, self.tails, self.grams
        out = [self.whole.__missing__(core)]
        out += [heads[core[:n]] for n in range(1, LONGEST_AFFIX + 1)]
        out += [tails[core[-n:]] for n in range(1, LONGEST_AFFIX + 1)]
        out += [grams[marked[i:i + 2]] for i in range(len(marked) - 1)]
        out += [grams[marked[i:i + 3]] for i in range(len(marked) - 2)]
        return out

    def trim(self) -> None:
        self.whole.clear()
        for known in (self.heads, self.tails, self.grams):
            if len(known) > self.CACHED:
                known.clear()


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray      # buckets x labels
    transitions: np.ndarray  # label before x label
    start: np.ndarray        # labels

    def emission(self, features: Sequence[int]) -> np.ndarray:
        return self.weights[features].sum(axis=0)

    def emissions(self, features: Sequence[Sequence[int]]) -> np.ndarray:
        """The scores of many words, none without features."""
        sizes = np.array([len(f) for f in features])
        flat = np.fromiter(itertools.chain.from_iterable(features), dtype=np.int64, count=int(sizes.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)


def _padded(sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(lengths.max())), dtype=np.int64)
    for row, s in zip(out, sequences):
        row[:len(s)] = s
    return out, lengths


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray,
              start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (step, sequence, label) and the summed probabilities of neighbouring labels.

    ``emissions`` is (step, sequence, label) and holds scores; steps beyond a
    sequence's length have probability zero.
    """
    steps, n, labels = emissions.shape
    local = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(local.dtype)
    live = np.arange(steps)[:, None] < lengths[None, :]
    forward = np.empty_like(local)
    state = np.exp(start - start.max()).astype(local.dtype) * local[0]
    state /= state.sum(axis=1, keepdims=True)
    forward[0] = state
    for t in range(1, steps):
        state = (state @ move) * local[t]
        state /= state.sum(axis=1, keepdims=True)
        forward[t] = state
    pairs = np.zeros((labels, labels))
    back = np.ones((n, labels), dtype=local.dtype)
    out = np.zeros_like(local)
    for t in range(steps - 1, -1, -1):
        product = forward[t] * back
        out[t] = product / product.sum(axis=1, keepdims=True) * live[t][:, None]
        if t:
            ahead = local[t] * back
            joint_norm = np.einsum("ni,ij,nj->n", forward[t - 1], move, ahead)
            scaled = forward[t - 1] * (live[t] / joint_norm)[:, None]
            pairs += move * (scaled.T @ ahead)
            before = ahead @ move.T
            before /= before.sum(axis=1, keepdims=True)
            back = np.where(live[t][:, None], before, back)
    return out, pairs


def label_shares(emissions: np.ndarray, lengths: np.ndarray, model: Crf) -> np.ndarray:
    """Per sequence the expected number of words of each label (forward-backward)."""
    steps, _, _ = emissions.shape
    local = emissions
    local -= local.max(axis=2, keepdims=True)
    np.exp(local, out=local)
    move = np.exp(model.transitions - model.transitions.max()).astype(local.dtype)
    ahead_move = np.ascontiguousarray(move.T)
    # Sequences come longest first, so those still running are the first rows.
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")
    forward = np.empty_like(local)
    state = np.exp(model.start - model.start.max()).astype(local.dtype) * local[0]
    state /= state.sum(axis=1, keepdims=True)
    forward[0] = state
    for t in range(1, steps):
        state = (state[:running[t]] @ move) * local[t, :running[t]]
        state /= state.sum(axis=1, keepdims=True)
        forward[t, :running[t]] = state
    total = np.zeros(local.shape[1:], dtype=np.float64)
    back = np.ones(local.shape[1:], dtype=local.dtype)
    for t in range(steps - 1, -1, -1):
        r = running[t]
        product = forward[t, :r] * back[:r]
        total[:r] += product / product.sum(axis=1, keepdims=True)
        if t:
            before = (local[t, :r] * back[:r]) @ ahead_move
            back[:r] = before / before.sum(axis=1, keepdims=True)
    return total


def _switched(samples: Sequence[tuple[int, np.ndarray]], rng: np.random.Generator,
              segment: tuple[int, int], length: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Code-switched training sequences: runs of words from several labelled texts in turn."""
    pieces = []
    for label, words in samples:
        at = 0
        while at < len(words):
            size = int(rng.integers(*segment))
            pieces.append((label, words[at:at + size]))
            at += size
    runs, labels, size = [], [], 0
    for i in rng.permutation(len(pieces)):
        label, run = pieces[i]
        runs.append(run)
        labels.append(np.full(len(run), label, dtype=np.int32))
        size += len(run)
        if size >= length:
            yield np.concatenate(runs), np.concatenate(labels)
            runs, labels, size = [], [], 0
    if runs:
        yield np.concatenate(runs), np.concatenate(labels)


def train(samples: Iterable[tuple[str, list[str]]], passes: int = 6, batch: int = 128, rate: float = 0.08,
          decay: float = 1e-5, segment: tuple[int, int] = (8, 48), length: int = 128, seed: int = 1) -> Crf:
    """Fit weights and transitions by Adam on the conditional log-likelihood of code-switched sequences.

    Texts are taken one by one and kept as numbers of their words, four bytes each.
    """
    known: dict[str, int] = {}
    numbered = [(label, np.array([known.setdefault(word, len(known)) for word in words], dtype=np.int32))
                for label, words in samples]
    names = sorted({label for label, _ in numbered})
    index = {label: i for i, label in enumerate(names)}
    k = len(names)
    rng = np.random.default_rng(seed)
    sequences, gold = map(list, zip(*_switched([(index[label], words) for label, words in numbered], rng, segment, length)))
    buckets, sizes = array.array("i"), []
    for word in known:
        found = features_of(word)
        buckets.extend(found)
        sizes.append(len(found))
    flat, sizes = np.array(buckets), np.array(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parameters = [np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(sequences))
        for low in range(0, len(order), batch):
            chosen = order[low:low + batch]
            padded, lengths = _padded([sequences[i] for i in chosen])
            labels, _ = _padded([gold[i] for i in chosen])
            live = np.arange(padded.shape[1])[None, :] < lengths[:, None]
            types, back = np.unique(padded, return_inverse=True)
            back = back.reshape(padded.shape)
            take = np.concatenate([flat[starts[t]:starts[t + 1]] for t in types])
            owner = np.repeat(np.arange(len(types)), sizes[types])
            scores = np.stack([np.bincount(owner, parameters[0][take, j], len(types)) for j in range(k)], axis=1)
            emissions = scores[back].transpose(1, 0, 2)
            probability, pairs = marginals(emissions, lengths, parameters[1], parameters[2])
            difference = np.eye(k)[labels] * live[:, :, None] - probability.transpose(1, 0, 2)
            by_type = np.stack([np.bincount(back[live], difference[live][:, j], len(types)) for j in range(k)], axis=1)
            seen = np.zeros((k, k))
            both = live[:, 1:]
            np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
            gradients = [np.stack([np.bincount(take, by_type[owner, j], BUCKETS) for j in range(k)], axis=1),
                         seen - pairs, difference[:, 0].sum(axis=0)]
            step += 1
            for p, g, m, v in zip(parameters, gradients, first, second):
                g = g / len(chosen) - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return Crf(names, parameters[0].astype(np.float32), parameters[1], parameters[2])


class Labeller:
    """Language shares of whole texts; remembers the scores of a bounded number of words."""

    CACHED_WORDS = 150_000
    STEP_WORDS = 1 << 19
    TOGETHER_LETTERS = 16 << 20
    SCORED_TOGETHER = 4_096

    def __init__(self, model: Crf):
        self.model = model
        self.features = Features()
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.labels)), dtype=np.float32)
        self.used = 0

    def _scored(self, core: str) -> int:
        """Row of the scores; they are there after ``_score_new``."""
        return self.cores.setdefault(core, len(self.cores))

    def _score_new(self) -> None:
        """Score the words seen since the last time, many together."""
        if len(self.cores) > len(self.scores):
            more = max(len(self.cores) - len(self.scores), len(self.scores))
            self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]), dtype=np.float32)])
        new = itertools.islice(self.cores, self.used, None)
        while words := list(itertools.islice(new, self.SCORED_TOGETHER)):
            self.scores[self.used:self.used + len(words)] = self.model.emissions([self.features.of(w) for w in words])
            self.used += len(words)
            self.features.trim()

    def _place(self, word: str) -> int:
        """Row of the word's scores; -1 for a word without letters, -2 for one of several pieces."""
        if not is_one(word):
            return -2
        core = letters_of(word)
        row = self._scored(core) if core else -1
        self.place[word] = row
        return row

    def _rows(self, text: str) -> np.ndarray:
        get, add = self.place.get, self._place
        words = text.split()
        found = [row if (row := get(word)) is not None else add(word) for word in words]
        rows = np.array(found, dtype=np.int32)
        if len(rows) and rows.min() == -2:
            rows = np.array([r for word, row in zip(words, found) for r in (
                (row,) if row != -2 else map(self._scored, tokens_of(word)))], dtype=np.int32)
        return rows[rows >= 0]

    def shares(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected words of each label, and words with letters, per text."""
        k = len(self.model.labels)
        out, counts = np.zeros((len(texts), k)), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            if max(len(self.place), len(self.cores)) > self.CACHED_WORDS:
                self._forget()
            # Texts of up to so many characters, and of not too many new pieces, share the row numbers of one memory.
            high, size, rows = at, 0, []
            while high < len(texts) and (high == at or size + len(texts[high]) < self.TOGETHER_LETTERS
                                         and len(self.cores) <= 2 * self.CACHED_WORDS):
                size += len(texts[high])
                rows.append(self._rows(texts[high]))
                high += 1
            self._score_new()
            lengths = np.array([len(r) for r in rows])
            counts[at:high] = lengths
            order = np.argsort(-lengths, kind="stable")
            order = order[lengths[order] > 0]
            while len(order):
                # Texts of similar length step together, longest first.
                longest = lengths[order[0]]
                n = max(1, min(len(order), int(self.STEP_WORDS // longest)))
                group, order = order[:n], order[n:]
                padded, _ = _padded([rows[i] for i in group])
                emissions = self.scores[padded.T]
                out[at + group] = label_shares(emissions, lengths[group], self.model)
            at = high
        return out, counts
