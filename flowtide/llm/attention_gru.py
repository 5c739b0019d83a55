"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its own vector, if it is in the vocabulary, and the sum of the vectors of its pieces of three
and four characters over the root of their number. Two gated recurrent layers read a window of words forwards and backwards; attention pools their
states, and a logistic unit scores the window. A text's score is that of its highest window; each window
overlaps the next, and the last one ends with the text.

The labels are of whole texts, so a text is marked by its worst passage: an epoch takes the highest window of
every text, and one at random of each unmarked one. Before the first epoch the highest window is the one with the
piece of a word that tells marked texts best, by the odds of all pieces. The weights that do best on the texts set
aside are kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 24
#: Sizes: inputs, states of one direction, attention, and buckets of pieces of words in bits.
INPUT, STATE, ATTENTION, PIECE_BITS = 16, 8, 8, 14
#: The vocabulary: words of at least so many of the texts to learn from.
IN_TEXTS = 5
#: Epochs, and how many of them go by before the highest windows are chosen anew.
EPOCHS, RENEWED, PATIENCE, BATCH, RATE, DECAY = 16, 2, 3, 64, 5e-3, 1e-4
#: Windows that are scored in one go.
BLOCK = 1024
#: Words whose inputs a scorer remembers.
REMEMBERED = 200_000

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
F32 = np.float32


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: letters and digits, A-Z in lower case, everything from U+0080 on a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of three and four characters of all words, with a mark on either side, and where
    each word's begin: as many of either length as the word has bytes."""
    line = np.frombuffer(b"".join(b"<%b> " % w for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    within = np.arange(int(lengths.sum())) + 3 * np.repeat(np.arange(len(words)), lengths)
    three = line[within] << 16 | line[within + 1] << 8 | line[within + 2]
    four = three * np.uint32(0x9E3779B1) + line[within + 3] + np.uint32(1)
    both = np.stack((three, four ^ (four >> np.uint32(15))), axis=1).reshape(-1)
    return ((both * np.uint32(2654435761)) >> np.uint32(32 - PIECE_BITS)).astype(np.int64), 2 * (np.cumsum(lengths) - lengths)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin; all words are covered."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    last = n - WINDOW
    return np.append(np.arange(0, last, STRIDE), last)


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts that stand behind each other: first word, words in it, and each text's first window."""
    firsts = [window_starts(int(n)) for n in lengths]
    counts = np.array([len(f) for f in firsts])
    offsets = np.repeat(np.cumsum(lengths) - lengths, counts)
    start = np.concatenate(firsts) + offsets
    size = np.minimum(np.repeat(lengths, counts), WINDOW)
    return start, size, np.cumsum(counts) - counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def initial(vocabulary: int, seed: int) -> dict[str, np.ndarray]:
    """Weights; the first word vector is that of all words outside the vocabulary and stays zero."""
    draw = np.random.default_rng(seed)
    some = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[0]), shape).astype(F32)
    weights = {
        "words": (0.1 * draw.normal(size=(vocabulary + 1, INPUT))).astype(F32), "chars": (0.1 * draw.normal(size=(1 << PIECE_BITS, INPUT))).astype(F32),
        "in": some(INPUT, 6 * STATE), "bias": np.zeros(6 * STATE, F32), "back": some(2, STATE, 3 * STATE),
        "look": some(2 * STATE, ATTENTION), "ask": some(ATTENTION), "out": some(2 * STATE), "prior": np.zeros(1, F32)}
    weights["words"][0] = 0
    return weights


def forward(w: dict[str, np.ndarray], gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows of the words ``ids`` (time, window). ``gates`` has for each direction the input gates of
    every word: reset, update and new. With ``keep``, also what ``backward`` needs."""
    steps, n = ids.shape
    s = STATE
    # the backward reader sees time turned round, so both take each step together
    on = np.stack((mask.T, mask.T[::-1]), axis=1)[..., None]  # time, direction, window, 1
    full = bool(mask.all())
    h, x = np.zeros((2, n, s), F32), np.empty((2, n, 3 * s), F32)
    states, kept = np.empty((steps, 2, n, s), F32), []
    for t in range(steps):
        np.take(gates[0], ids[t], axis=0, out=x[0])
        np.take(gates[1], ids[steps - 1 - t], axis=0, out=x[1])
        inner = np.matmul(h, w["back"])
        ru = inner[:, :, : 2 * s] + x[:, :, : 2 * s]
        ru *= F32(0.5)
        np.tanh(ru, out=ru)
        ru += F32(1)
        ru *= F32(0.5)
        r, u = ru[:, :, :s], ru[:, :, s:]
        new = r * inner[:, :, 2 * s :]
        new += x[:, :, 2 * s :]
        np.tanh(new, out=new)
        step = (new - h) * (F32(1) - u)
        if not full:
            step *= on[t]
        if keep:
            kept.append((h, r, u, new, inner[:, :, 2 * s :]))
        h = np.add(h, step, out=states[t])
    both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)  # time, window, 2 states
    seen = np.tanh(both @ w["look"])
    asked = np.where(mask.T > 0, seen @ w["ask"], F32(-1e9))
    share = np.exp(asked - asked.max(axis=0))
    share *= mask.T
    share /= np.maximum(share.sum(axis=0), F32(1e-9))
    pooled = np.einsum("tn,tns->ns", share, both)
    logits = pooled @ w["out"] + w["prior"][0]
    return (logits, (on, kept, both, seen, share, pooled)) if keep else logits


def backward(w: dict[str, np.ndarray], mask: np.ndarray, kept, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights behind the inputs, and of the input gates (direction, time, window, gate)."""
    on, cells, both, seen, share, pooled = kept
    steps, n, _ = both.shape
    s = STATE
    grads = {"out": pooled.T @ d_logits, "prior": d_logits.sum(keepdims=True)}
    d_pooled = d_logits[:, None] * w["out"]
    d_both = share[..., None] * d_pooled
    d_share = (both * d_pooled).sum(axis=2)
    d_asked = share * (d_share - (share * d_share).sum(axis=0))
    d_seen = d_asked[..., None] * w["ask"] * (1 - seen**2)
    grads["ask"] = np.einsum("tna,tn->a", seen, d_asked)
    grads["look"] = np.einsum("tns,tna->sa", both, d_seen)
    d_both = d_both + d_seen @ w["look"].T
    d_states = np.stack((d_both[:, :, :s], d_both[::-1, :, s:]), axis=1)
    d_turned = np.zeros((steps, 2, n, 3 * s), F32)
    grads["back"] = np.zeros_like(w["back"])
    d_h = np.zeros((2, n, s), F32)
    for t in range(steps - 1, -1, -1):
        before, r, u, new, inner = cells[t]
        d_h = d_h + d_states[t]
        d_step = on[t] * d_h
        d_u = -d_step * (new - before) * u * (1 - u)
        d_new = d_step * (1 - u) * (1 - new**2)
        d_r = d_new * inner * r * (1 - r)
        d_turned[t] = np.concatenate((d_r, d_u, d_new), axis=2)
        d_inner = np.concatenate((d_r, d_u, d_new * r), axis=2)
        grads["back"] += np.matmul(before.transpose(0, 2, 1), d_inner)
        d_h = d_h - d_step * (1 - u) + np.matmul(d_inner, w["back"].transpose(0, 2, 1))
    return grads, np.stack((d_turned[:, 0], d_turned[::-1, 1]))


def input_gates(w: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """Of each direction and word: what its input adds to the gates."""
    return np.ascontiguousarray((inputs @ w["in"] + w["bias"]).reshape(len(inputs), 2, 3 * STATE).transpose(1, 0, 2))


class Network:
    """A trained network: ``scores`` of texts."""

    def __init__(self, vocabulary: dict[bytes, int], weights: dict[str, np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights
        self._forget()

    def __getstate__(self):
        return self.vocabulary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self._rows: defaultdict[bytes, int] = defaultdict()
        self._rows.default_factory = self._rows.__len__
        self._rows[b""]  # stands for places without a word
        self._gates = np.zeros((2, 1, 3 * STATE), F32)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input of each word."""
        codes, starts = pieces(words)
        counts = np.diff(np.append(starts, len(codes)))
        chars = np.add.reduceat(self.weights["chars"][codes], starts, axis=0) / np.sqrt(counts[:, None].astype(F32))
        return self.weights["words"][[self.vocabulary.get(w, 0) for w in words]] + chars

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The places of words in the table of input gates; new words are added."""
        places = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
        known = self._gates.shape[1]
        if len(self._rows) > known:
            new = list(islice(self._rows, known, None))
            self._gates = np.concatenate((self._gates, input_gates(self.weights, self.inputs(new))), axis=1)
        return places

    def logits(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the windows of the words given by their places."""
        out = np.empty(len(start), F32)
        words = np.append(words, np.zeros(WINDOW, np.int64))
        for at in range(0, len(start), BLOCK):
            longest = max(1, int(size[at : at + BLOCK].max()))
            mask = (np.arange(longest) < size[at : at + BLOCK, None]).astype(F32)
            ids = words[start[at : at + BLOCK, None] + np.arange(longest)]
            out[at : at + BLOCK] = forward(self.weights, self._gates, np.ascontiguousarray(ids.T), mask)
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The score of each text's highest window, from 0 to 1."""
        words = [words_of(t) for t in texts]
        if not words:
            return np.empty(0, F32)
        if len(self._rows) > REMEMBERED:
            self._forget()
        ids = self.rows([w for ws in words for w in ws])
        start, size, first = windows_of(np.array([len(ws) for ws in words]))
        return sigmoid(np.maximum.reduceat(self.logits(ids, start, size), first))


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.turn = weights, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        clip = F32(min(1.0, 5.0 / max(size, 1e-9)))
        rate = RATE * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for name, grad in grads.items():
            grad = clip * grad
            self.mean[name] += F32(0.1) * (grad - self.mean[name])
            self.square[name] += F32(0.001) * (grad**2 - self.square[name])
            decayed = F32(1 - DECAY) if name in ("words", "chars", "in", "out") else F32(1)
            self.weights[name] *= decayed
            self.weights[name] -= F32(rate) * self.mean[name] / (np.sqrt(self.square[name]) + F32(1e-8))


def loss_and_gradients(weights: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, vocabulary: np.ndarray, codes: np.ndarray,
                       starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Of windows of the words ``ids`` (window, time). For every word there are its place in the vocabulary and,
    in ``codes`` from ``starts`` on, its pieces."""
    used, place = np.unique(ids, return_inverse=True)
    place = place.reshape(ids.shape)
    counts = (np.append(starts, len(codes))[used + 1] - starts[used]).astype(np.int64)
    own = np.repeat(starts[used] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    buckets, bounds = codes[own], np.cumsum(counts) - counts
    x = weights["words"][vocabulary[used]] + np.add.reduceat(weights["chars"][buckets], bounds, axis=0) / np.sqrt(counts[:, None].astype(F32))
    gates = input_gates(weights, x)
    logits, kept = forward(weights, gates, place.T, mask, keep=True)
    probability = sigmoid(logits)
    loss = float((weight * (np.logaddexp(0, logits) - target * logits)).sum() / weight.sum())
    grads, d_gates = backward(weights, mask, kept, (weight * (probability - target) / weight.sum()).astype(F32))
    d_word = np.zeros_like(gates)
    for reader in (0, 1):
        np.add.at(d_word[reader], place.T.reshape(-1), d_gates[reader].reshape(-1, d_gates.shape[3]))
    d_word = np.concatenate((d_word[0], d_word[1]), axis=1)
    grads["in"], grads["bias"] = x.T @ d_word, d_word.sum(axis=0)
    d_x = d_word @ weights["in"].T
    grads["words"] = np.zeros_like(weights["words"])
    np.add.at(grads["words"], vocabulary[used], d_x)
    grads["words"][0] = 0
    grads["chars"] = np.zeros_like(weights["chars"])
    np.add.at(grads["chars"], buckets, np.repeat(d_x / np.sqrt(counts[:, None].astype(F32)), counts, axis=0))
    return loss, grads


def _odds(words: list[list[bytes]], number: dict[bytes, int], codes: np.ndarray, starts: np.ndarray, target: np.ndarray,
          aside: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each window the highest odds of any piece to stand in a marked text."""
    bounds = np.append(starts, len(codes))
    seen = np.zeros((2, 1 << PIECE_BITS), F32)
    for i in np.flatnonzero(~aside):
        distinct = {number[w] for w in words[i]}
        seen[int(target[i] > 0), np.unique(np.concatenate([codes[bounds[k] : bounds[k + 1]] for k in distinct]))] += 1
    texts = np.array([[(target[~aside] == 0).sum()], [(target[~aside] > 0).sum()]])
    share = np.log((seen + 0.5) / (texts + 1))
    told = np.append(np.maximum.reduceat((share[1] - share[0])[codes], starts), -np.inf)
    inside = np.arange(WINDOW) < size[:, None]
    return told[np.where(inside, flat[start[:, None] + np.arange(WINDOW)], -1)].max(axis=1)


def train(texts: list[str], marked: list[int], weight: list[float], seed: int = 12, epochs: int = EPOCHS) -> Network | None:
    """A network of labelled texts; every sixth is set aside to stop by. None without a text of any word."""
    words = [words_of(t) for t in texts]
    usable = [i for i, ws in enumerate(words) if ws]
    if not usable:
        return None
    words, target = [words[i] for i in usable], np.array([marked[i] for i in usable], F32)
    weight = np.array([weight[i] for i in usable], F32)
    aside = np.arange(len(words)) % 6 == 5
    texts_with = Counter(w for i, ws in enumerate(words) if not aside[i] for w in set(ws))
    kept_words = sorted(w for w, n in texts_with.items() if n >= IN_TEXTS)
    vocabulary = {w: i + 1 for i, w in enumerate(kept_words)}
    distinct = sorted({w for ws in words for w in ws})
    number = {w: i for i, w in enumerate(distinct)}
    places = np.array([vocabulary.get(w, 0) for w in distinct])
    codes, starts = pieces(distinct)
    flat = np.array([number[w] for ws in words for w in ws] + [0] * WINDOW)
    start, size, first = windows_of(np.array([len(ws) for ws in words]))
    of_text = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(start))))
    weights = initial(len(vocabulary), seed)
    share = float((weight * target).sum() / weight.sum())
    weights["prior"][0] = np.log((share + 0.01) / (1.01 - share))
    draw, adam = np.random.default_rng(seed), _Adam(weights)
    best, best_loss, waited = None, np.inf, 0
    learn = np.flatnonzero(~aside)
    unmarked = learn[target[learn] == 0]
    many = np.diff(np.append(first, len(start)))

    def top(values: np.ndarray) -> np.ndarray:
        """The highest window of each text."""
        return np.lexsort((-values, of_text))[first]

    def now() -> np.ndarray:
        network = Network(vocabulary, weights)
        network._gates = input_gates(weights, network.inputs(distinct))
        return network.logits(flat[:-WINDOW], start, size)

    highest = top(_odds(words, number, codes, starts, target, aside, flat, start, size))
    for epoch in range(epochs):
        some = first[unmarked] + (draw.random(len(unmarked)) * many[unmarked]).astype(np.int64)
        chosen = draw.permutation(np.concatenate((highest[learn], some)))
        for at in range(0, len(chosen), BATCH):
            rows = chosen[at : at + BATCH]
            mask = (np.arange(WINDOW) < size[rows, None]).astype(F32)
            ids = flat[start[rows, None] + np.arange(WINDOW)]
            _, grads = loss_and_gradients(weights, ids, mask, places, codes, starts, target[of_text[rows]], weight[of_text[rows]])
            adam.step(grads)
        if (epoch + 1) % RENEWED:
            continue
        logits = now()
        highest = top(logits)
        if not aside.any():
            continue
        left = logits[highest][aside]
        loss = float((weight[aside] * (np.logaddexp(0, left) - target[aside] * left)).sum() / weight[aside].sum())
        if loss < best_loss - 1e-4:
            best, best_loss, waited = {k: v.copy() for k, v in weights.items()}, loss, 0
        else:
            waited += 1
            if waited == PATIENCE:
                break
    return Network(vocabulary, best or weights)
