"""LM scoring with a causal self-attention model over subwords, trained in numpy.

A text is its lower-cased words, in order, and an end. Words become subwords of a public byte-level vocabulary. The
most frequent subwords of the training texts are groups of their own, all others share one group and are told apart
inside it by their smoothed counts; groups are gathered in classes. A window of subwords is embedded with positions,
one layer of masked self-attention and a feed-forward layer follow, and from its state a softmax predicts the class of
the next one, and a second softmax its group among those of that class; what the pair counts of the last two groups say
is added to the logits of both, so the network learns what pairs don't tell. The probabilities of all texts sum to one.

Windows overlap: the first part of a window is context, the rest is scored, so every subword is scored once;
many windows go through each matrix product.

Texts are cut into words and subwords once. What is kept of them is a table of chunks: the words of some texts as
numbers in the chunk's own list of words, and the hash and the subwords of each word in that list. Learning and
scoring read that table.

Counts cover all training texts. The network learns by local Adam steps in every partition of the chunks and by
averaging over the partitions after each round. Every window of every training text is learned from: the batches of a
chunk are dealt to the rounds in turn. Only sums of a fixed number of parameters and counts reach the driver.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop, read, save
from .token_counts import PATTERN, read_ranks
from .toxicity import held_out

CONTEXT, SCORED = 8, 16
#: Classes, and how many of them hold several groups. Each group has an output vector of its own in either case.
CLASSES, CLUSTERS = 40, 16
GROUPS = 1024
#: What smoothing takes from every pair count, for single counts to hand out.
DISCOUNT = 0.75
WIDTH, HIDDEN = 16, 24
ROUNDS = 2
#: A corpus of fewer batches than STEPS is gone through again, at most PASSES times in all.
STEPS, PASSES = 2500, 8
BATCH = 128
#: The rate of steps falls to half after so many steps of a round.
RATE, FALL = 0.03, 800
#: The most frequent words, whose counts are broadcast; the counts of others are joined.
COMMON = 200_000
SEED = 20260829
END_WORD = 0  # stands for the end among the hashes of words


#: White space outside ASCII that the pattern of subwords knows.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pattern without the look behind white space, which is slow and matters only where white space follows white space.
_PLAIN = PATTERN.replace(r"|\s+(?!\S)", "")


@lru_cache(maxsize=1)
def _ranks(ranks: bytes) -> tuple:
    """Of a file of ranks: how many subwords there are, and which begin with a space. Kept by a worker for the tasks to come."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    spaced = np.zeros(max(table.values()) + 1, bool)
    spaced[[i for b, i in table.items() if b.startswith(b" ")]] = True
    return len(spaced), spaced


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    """The function that encodes by a file of ranks and a pattern; kept as well."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


def _strings(array: pa.Array) -> list[bytes]:
    """The values of an array of strings without nulls, as bytes."""
    array = array.cast(pa.large_binary())
    if not len(array):
        return []
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in pairwise(ends)]


class Vocabulary:
    """Subwords by number, and the end after them."""

    def __init__(self, ranks: bytes):
        self._file = ranks
        self.end, self._spaced = _ranks(ranks)
        self.size = self.end + 1

    def encode(self, text: str) -> list[int]:
        """The subwords of any text."""
        return _encoder(self._file, PATTERN)(text)

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of all words in a row, each word after a space, and how many each has.

        Many words are encoded at once: a subword that begins with a space begins a word, as words have none inside.
        Where white space outside ASCII hides a beginning, words are encoded one by one.
        """
        out, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        plain = _encoder(self._file, _PLAIN)
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            text = (b" " + b" ".join(part)).decode()
            ids = np.array((self.encode if not text.isascii() and _SPACES.search(text) else plain)(text), np.int32)
            first = np.flatnonzero(self._spaced[ids])
            if len(first) == len(part) and first[0] == 0:
                lengths.append(np.diff(np.append(first, len(ids))))
            else:
                each = [self.encode(" " + w.decode()) for w in part]
                ids, own = np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))
                lengths.append(own)
            out.append(ids)
        return np.concatenate(out), np.concatenate(lengths)

    def read(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The last five columns of a chunk, of these texts; null texts are empty."""
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
        coded = split.flatten().dictionary_encode()
        words, flat = _strings(coded.dictionary), coded.indices.to_numpy()
        sizes = pa.compute.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if b"" in words:  # before white space that begins a text, or behind the last
            empty = words.index(b"")
            there = flat != empty
            sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])])
            flat = flat[there]
            flat = flat - (flat > empty)
            del words[empty]
        pieces, lengths = self._pieces(words)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        return {"sizes": sizes, "words": flat, "hashes": np.where(h == END_WORD, 1, h), "lengths": lengths, "pieces": pieces}


def spell(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of texts, given as runs of word numbers, each closed by ``end``, and how many each has."""
    n = lengths[flat]
    out = pieces[np.repeat(starts[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)]
    return np.insert(out, ends, end), np.diff(np.concatenate([[0], ends])) + 1


#: Columns of a chunk: of its texts the ids, whether these are null, PART and the number of words; the words of all
#: texts in a row, as numbers; of each word its hash, how many subwords it has, and these in a row.
_CHUNK = ("ids", "nulls", "parts", "sizes", "words", "hashes", "lengths", "pieces")
_KINDS = {"ids": np.int64, "nulls": np.bool_, "parts": np.int8, "sizes": np.int32, "hashes": np.int64, "lengths": np.int32, "pieces": np.int32}
#: What becomes of a text: it is learned from, held out, or has no id and is only scored.
LEARNED, HELD, NEITHER = 0, 1, 2


class Chunk:
    """Some texts as numbers."""

    def __init__(self, **columns):
        self.__dict__.update(columns)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def packed(self) -> list[bytes]:
        """A row of the table; words take two bytes each where that is enough."""
        few = len(self.hashes) <= 1 << 16
        return [np.asarray(getattr(self, k), _KINDS.get(k, np.uint16 if few else np.uint32)).tobytes() for k in _CHUNK]

    @classmethod
    def unpacked(cls, row: list[bytes]) -> Chunk:
        got = dict(zip(_CHUNK, row, strict=True))
        out = {k: np.frombuffer(got[k], kind) for k, kind in _KINDS.items()}
        out["words"] = np.frombuffer(got["words"], np.uint16 if len(out["hashes"]) <= 1 << 16 else np.uint32)
        return cls(**out)

    def subwords(self, end: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``spell``, of all texts or of some."""
        flat, sizes = self.words, self.sizes.astype(np.int64)
        if only is not None:
            flat, sizes = flat[np.repeat(only, sizes)], sizes[only]
        return spell(flat, sizes, self.starts, self.lengths.astype(np.int64), self.pieces, end)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first scored place in the flat row, places scored, places of context) of all windows of all texts."""
    per = -(-sizes // SCORED)
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(sizes) - sizes)[text] + number * SCORED
    return begin, np.minimum(SCORED, sizes[text] - number * SCORED), np.minimum(CONTEXT, number * SCORED)


def shapes(groups: int, classes: int, width: int = WIDTH, hidden: int = HIDDEN) -> list[tuple[str, tuple]]:
    """Names and shapes of the parameters.

    One head of full width: ``relate`` is the product of its query and key matrices, ``carry`` that of its value and
    output matrices, so neither keys nor values have to be made.
    """
    return [
        ("embed", (groups, width)), ("place", (CONTEXT + SCORED, width)), ("relate", (width, width)), ("carry", (width, width)),
        ("up", (width, hidden)), ("up_bias", (hidden,)), ("down", (hidden, width)), ("out", (width, classes)), ("out_bias", (classes,)),
    ]


def start(groups: int, classes: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters before training: the network adds almost nothing to what pair counts say."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "place": 0.1, "out": 0.02, "out_bias": 0.0, "up_bias": 0.0}
    return {k: rng.normal(0, scale.get(k, 0.5 / np.sqrt(s[0])), s).astype(np.float32) for k, s in shapes(groups, classes)}


_PLACES = np.arange(CONTEXT + SCORED)
#: Scored place i stands at CONTEXT + i and sees itself and all before it: inputs are shifted by one, so not its own
#: target. Without context, places before CONTEXT are not there.
_CAUSAL = (_PLACES[None, :] <= (CONTEXT + np.arange(SCORED))[:, None]).astype(np.float32)


def segments(row: np.ndarray, end: int) -> np.ndarray:
    """By first place of a window, what it reads and predicts: the symbols from one before its context to its last.

    A view, of which windows take rows. Before the first of a text stands the end of the text before it; before the
    first of all, an end as well. Places outside a window's text are there, but nothing that counts sees them.
    """
    padded = np.concatenate([np.full(CONTEXT + 1, end, row.dtype), row, np.full(SCORED, end, row.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + SCORED + 1)


def _attend(p: dict, x: np.ndarray, context: np.ndarray):
    """The states before the softmax, and what training needs; scores are small, so exponentials need no shift, but in rare
    cases, which are clipped."""
    h = np.take(p["embed"], x, axis=0, mode="clip")
    h += p["place"]
    d = h.shape[2]
    own = np.ascontiguousarray(h[:, CONTEXT:])
    asked = (own.reshape(-1, d) @ (p["relate"] * np.asarray(1 / np.sqrt(d), h.dtype))).reshape(own.shape)
    keys, alone = h.transpose(0, 2, 1), context == 0
    ones = np.ones(CONTEXT + SCORED, h.dtype)

    def weigh(s):
        np.exp(s, out=s)
        s *= _CAUSAL
        s[alone, :, :CONTEXT] = 0
        return s, (s.reshape(-1, len(ones)) @ ones).reshape(-1, SCORED, 1)

    with np.errstate(over="ignore", invalid="ignore"):
        s, total = weigh(np.matmul(asked, keys))
    if not (np.isfinite(total).all() and total.min() > 0):
        s, total = weigh(np.clip(np.matmul(asked, keys), -60, 60))
    seen = np.matmul(s, h)
    seen /= total
    seen = seen.reshape(-1, d)
    r = own.reshape(-1, d) + seen @ p["carry"]
    u = r @ p["up"]
    u += p["up_bias"]
    np.maximum(u, 0, out=u)
    return r + u @ p["down"], (h, own, asked, s, total, seen, r, u)


def _shares(p: dict, z: np.ndarray, told: np.ndarray):
    """Exponentials of the logits, and the sums of those; shifted only where it is needed. ``told``: from pair counts."""
    e = z @ p["out"]
    e += told
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    if not (np.isfinite(total).all() and total.min() > 0):
        e = z @ p["out"] + told
        e = np.exp(e - e.max(1, keepdims=True))
        total = e.sum(1)
    return e, total


class Members:
    """The groups of each class, of which a second softmax tells the next one: a row of logits for each target in a class of several.

    ``within``: logits of groups by the group before. The parameter ``pick`` has a row a group, in the order of classes,
    the bias in its last column. Targets come in the order of their classes, those of several groups last. Rows of logits
    differ in length, so all stand in one flat array, and only products with parameters go class by class.
    """

    def __init__(self, within: np.ndarray, class_of: np.ndarray):
        order = np.argsort(class_of, kind="stable")
        self.class_of, self.size = class_of.astype(np.int16), np.bincount(class_of)
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.begin[class_of[order]]
        self.told = [np.ascontiguousarray(within[:, order[b : b + n]]) if n > 1 else None for b, n in zip(self.begin, self.size)]
        # By group the turn of its class, and by turn the class.
        self.classes = np.argsort(self.size > 1, kind="stable")
        turn = np.empty(len(self.size), np.int16)
        turn[self.classes] = np.arange(len(self.size))
        self.turn, self.alone = turn[class_of], int((self.size <= 1).sum())
        self.width = self.size[class_of]

    def sort(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of targets that ``shares`` wants, and how many there are by turn of class."""
        turns = np.take(self.turn, after)
        return np.argsort(turns, kind="stable"), np.bincount(turns, minlength=len(self.size))

    def shares(self, pick: np.ndarray, states: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray):
        """Of sorted targets, with ``states`` that end in a one: the first row in a class of several groups, and of those
        from there on parts (rows of ``pick``, own rows, places in the flat array), exponentials of the logits, and by row
        its sum, own place and own logit."""
        skip = int(counts[: self.alone].sum())
        before, after, states = before[skip:], after[skip:], states[skip:]
        width = np.take(self.width, after)
        ends = np.cumsum(width)
        starts = ends - width
        target = starts + np.take(self.place, after)
        e = np.empty(int(ends[-1]) if len(ends) else 0, states.dtype)
        parts, i, at = [], 0, 0
        for k, n in zip(self.classes[self.alone :].tolist(), counts[self.alone :].tolist()):
            if n:
                b, m = int(self.begin[k]), int(self.size[k])
                part = e[at : at + n * m].reshape(n, m)
                np.matmul(states[i : i + n], pick[b : b + m].T, out=part)
                part += self.told[k].take(before[i : i + n], axis=0, mode="clip")
                parts.append((slice(b, b + m), slice(i, i + n), slice(at, at + n * m)))
                i, at = i + n, at + n * m
        own = e[target]
        if not len(after):
            return skip, parts, e, own, target, own
        with np.errstate(over="ignore"):
            shares = np.exp(e)
        total = np.add.reduceat(shares, starts)
        if not (np.isfinite(total).all() and total.min() > 0):
            most = np.maximum.reduceat(e, starts)
            shares, own = np.exp(e - np.repeat(most, width)), own - most
            total = np.add.reduceat(shares, starts)
        return skip, parts, shares, total, target, own

    def gradients(self, pick: np.ndarray, states: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray, weight: np.ndarray, dz: np.ndarray) -> np.ndarray:
        """Of the negative log-probabilities inside classes, times ``weight`` of each target; adds to ``dz``."""
        skip, parts, e, total, target, _ = self.shares(pick, states, before, after, counts)
        g, back = np.zeros_like(pick), np.empty((len(states) - skip, states.shape[1] - 1), states.dtype)
        e[target] -= total
        weight = (weight[skip:] / total).astype(e.dtype)[:, None]
        states = states[skip:] * weight
        for of_pick, own, flat in parts:
            d = e[flat].reshape(own.stop - own.start, -1)
            np.matmul(d.T, states[own], out=g[of_pick])
            np.matmul(d, pick[of_pick, :-1], out=back[own])
        back *= weight
        dz[skip:] += back
        return g


def _with_ones(z: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Rows of states in this order, each with a one behind it, which biases are multiplied by."""
    out = np.empty((len(z), z.shape[1] + 1), z.dtype)
    out[:, :-1] = z if order is None else z.take(order, axis=0, mode="clip")
    out[:, -1] = 1
    return out


def log_probabilities(
    p: dict, seg: np.ndarray, context: np.ndarray, pairs: np.ndarray, class_of: np.ndarray, weights: np.ndarray | None = None, members: Members | None = None
) -> np.ndarray:
    """Natural log-probabilities of the targets' classes, with ``members`` of their groups, window by scored place.

    ``pairs``: logits of classes by the group before, with the output bias in them; ``weights``: their exponentials.
    """
    z, _ = _attend(p, seg[:, :-1], context)
    after, before = seg[:, CONTEXT + 1 :].reshape(-1), seg[:, CONTEXT:-1].reshape(-1)
    y = class_of[after]
    classes = pairs.shape[1]
    at = np.arange(0, len(y) * classes, classes) + y
    weights = np.exp(pairs) if weights is None else weights
    with np.errstate(over="ignore", invalid="ignore"):
        e = z @ p["out"]
        own = e.reshape(-1)[at] + pairs.reshape(-1)[before.astype(np.int64) * classes + y]
        np.exp(e, out=e)
        total = np.einsum("ij,ij->i", e, weights.take(before, axis=0, mode="clip"))
        if not (np.isfinite(total).all() and total.min() > 0):
            e, total = _shares(p, z, pairs[before])
            own = np.log(np.maximum(e.reshape(-1)[at], 1e-37))
    out = own - np.log(total)
    if members is not None:
        order, counts = members.sort(after)
        skip, _, _, total, _, own = members.shares(p["pick"], _with_ones(z, order), before[order], after[order], counts)
        out[order[skip:]] += own - np.log(total)
    return out.reshape(len(seg), SCORED)


def gradients(p: dict, seg: np.ndarray, context: np.ndarray, scored: np.ndarray, pairs: np.ndarray, class_of: np.ndarray, members: Members | None = None) -> dict:
    """Of the mean negative log-probability of the classes, with ``members`` of the groups, at the scored places; ``pairs`` without bias."""
    x, after, before = seg[:, :-1], seg[:, CONTEXT + 1 :].reshape(-1), seg[:, CONTEXT:-1].reshape(-1)
    z, (h, own, asked, s, total, seen, r, u) = _attend(p, x, context)
    w = (np.arange(SCORED)[None, :] < scored[:, None]).reshape(-1)
    n = max(1, int(w.sum()))
    # The softmaxes take targets in the order of their classes.
    order = None
    if members is not None:
        order, counts = members.sort(after)
        after, before, w = after[order], before[order], w[order]
    states, y = _with_ones(z, order), class_of[after]
    with np.errstate(over="ignore"):
        e, sums = _shares({"out": np.concatenate([p["out"], p["out_bias"][None]])}, states, pairs.take(before, axis=0, mode="clip"))
    # Rows are scaled where they are narrow.
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + y] -= sums
    weight = (w / (n * sums)).astype(e.dtype)[:, None]
    of_out = (states * weight).T @ e
    g = {"out": of_out[:-1], "out_bias": of_out[-1]}
    dz = e @ p["out"].T
    dz *= weight
    if members is not None:
        g["pick"] = members.gradients(p["pick"], states, before, after, counts, w / n, dz)
        sorted_dz, dz = dz, np.empty_like(dz)
        dz[order] = sorted_dz
    du = dz @ p["down"].T
    du *= u > 0
    g |= {"down": u.T @ dz, "up": r.T @ du, "up_bias": np.ones(len(du), du.dtype) @ du}
    dr = du @ p["up"].T
    dr += dz
    g["carry"] = seen.T @ dr
    # The weights of attention are s / total. What is subtracted from their gradients in a softmax, and the division, are
    # applied to the narrow factors of the products that these are in.
    total = total.reshape(-1, 1)
    if total.min() < 1e-20 or total.max() > 1e20:
        s, total = s / total.reshape(*s.shape[:2], 1), np.ones_like(total)
    dseen = dr @ p["carry"].T
    dseen /= total
    less = np.einsum("ij,ij->i", dseen, seen)[:, None]
    # What keys and values get is one product: weights and their gradients, by what was seen and what was asked.
    given = np.empty((len(h), 2 * SCORED, h.shape[1]), h.dtype)
    both = np.empty((len(h), 2 * SCORED, h.shape[2]), h.dtype)
    given[:, :SCORED] = s
    ds = np.matmul(dseen.reshape(own.shape), h.transpose(0, 2, 1), out=given[:, SCORED:])
    ds *= s
    both[:, SCORED:] = asked
    np.subtract(dseen.reshape(own.shape), less.reshape(*s.shape[:2], 1) * asked, out=both[:, :SCORED])
    two = lambda a: a.reshape(-1, a.shape[2])
    met = two(np.matmul(ds, h))
    met -= (less * total) * seen
    met *= np.asarray(1 / np.sqrt(h.shape[2]), h.dtype)
    g["relate"] = two(own).T @ met
    dh = np.matmul(given.transpose(0, 2, 1), both)
    dr += met @ p["relate"].T
    dh[:, CONTEXT:] += dr.reshape(own.shape)
    g["place"] = (np.ones(len(dh), dh.dtype) @ dh.reshape(len(dh), -1)).reshape(dh.shape[1:])
    cells = np.arange(p["embed"].size).reshape(p["embed"].shape).take(x.reshape(-1), axis=0, mode="clip")
    g["embed"] = np.bincount(cells.reshape(-1), dh.reshape(-1), p["embed"].size).reshape(p["embed"].shape)
    return g


class Learner:
    """Adam over batches of windows (segments, context, scored), from a copy of a model's parameters; all stand in one row."""

    def __init__(self, model: Model, rate: float):
        self.row = np.concatenate([v.reshape(-1) for v in model.learned().values()])
        self.p = _unflatten(self.row, model.learned())
        self.pairs, self.class_of, self.members = model.pairs, model.class_of, model.members
        self.rate, self.steps = rate, 0
        self._first, self._second = np.zeros_like(self.row), np.zeros_like(self.row)

    def learn(self, batches: list[tuple], seed: int = 0) -> None:
        a, b = self._first, self._second
        g, step = np.empty_like(a), np.empty_like(a)
        for i in np.random.default_rng(seed).permutation(len(batches)):
            got = gradients(self.p, *batches[i], self.pairs, self.class_of, self.members)
            np.concatenate([got[k].reshape(-1) for k in self.p], out=g, casting="same_kind")
            self.steps += 1
            t = self.steps
            # The moments are kept as sums, 10 and 100 times the averages.
            a *= 0.9
            a += g
            b *= 0.99
            g *= g
            b += g
            root = np.sqrt((1 - 0.99**t) / 0.01)
            np.sqrt(b, out=step)
            step += 1e-8 * root
            np.divide(a, step, out=step)
            step *= self.rate * root * 0.1 / (1 + t / FALL) / (1 - 0.9**t)
            self.row -= step


def _unflatten(row: np.ndarray, like: dict) -> dict:
    """Parameters of these names and shapes, as views of a row of them."""
    out, at = {}, 0
    for k, v in like.items():
        out[k], at = row[at : at + v.size].reshape(v.shape), at + v.size
    return out


class Model:
    """What scoring needs: parameters, groups and classes of subwords, and what pair counts say.

    ``pick`` is the parameter of the softmax inside classes, which before training repeats what pair counts say there.

    ``subword_counts`` by subword, the end last; ``pair_counts`` as arrays (subword before, subword, count).
    """

    def __init__(self, subword_counts: np.ndarray, pair_counts: tuple, groups: int = GROUPS, classes: int = CLASSES, clusters: int = CLUSTERS):
        size = len(subword_counts)
        order = np.argsort(-subword_counts, kind="stable")
        order = order[order != size - 1][: groups - 2]
        self.end_group = groups - 1
        self.group_of = np.full(size, groups - 2, np.int32)
        self.group_of[order] = np.arange(len(order))
        self.group_of[size - 1] = self.end_group
        rare = self.group_of == groups - 2
        weight = np.where(rare, subword_counts + 0.5, 0)
        self.inside = np.where(rare, np.log(np.where(rare, weight, 1) / max(weight.sum(), 0.5)), 0.0)
        single = np.bincount(self.group_of, subword_counts, groups)
        alone = (single + 0.5) / (single.sum() + 0.5 * groups)
        before, after, n = pair_counts
        pairs = np.bincount(self.group_of[before].astype(np.int64) * groups + self.group_of[after], n, groups * groups).reshape(groups, groups)
        # Each pair gives up a part of its count, which is handed out by single counts.
        total, kept = pairs.sum(1, keepdims=True), np.maximum(pairs - DISCOUNT, 0)
        said = np.where(total > 0, (kept + (total - kept.sum(1, keepdims=True)) * alone) / np.maximum(total, 1e-9), alone)
        # The most frequent groups are classes; the others are gathered by frequency, many rare or a few frequent ones in a
        # class, so that the softmax inside classes has few rows to add up: those of a target's class.
        own = classes - clusters
        by_count = np.argsort(-single, kind="stable")
        self.class_of = np.empty(groups, np.int32)
        self.class_of[by_count[:own]] = np.arange(own)
        rest = np.cumsum(np.sqrt(single[by_count[own:]] + 0.5))
        self.class_of[by_count[own:]] = own + np.minimum(rest / rest[-1] * clusters, clusters - 1).astype(np.int32)
        member = np.zeros((groups, classes))
        member[np.arange(groups), self.class_of] = 1
        with np.errstate(divide="ignore"):
            of_class = np.log(said @ member)
        of_class[~np.isfinite(of_class)] = -60.0  # a class without groups
        self.pairs = of_class.astype(np.float32)
        self.within = (np.log(said) - of_class[:, self.class_of]).astype(np.float32)
        self.members = Members(self.within, self.class_of)
        self.parameters = start(groups, classes)
        self.pick = np.zeros((groups, self.parameters["embed"].shape[1] + 1), np.float32)

    def learned(self) -> dict[str, np.ndarray]:
        """All parameters by name."""
        return self.parameters | {"pick": self.pick}

    def score(self, pieces: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """log10 probability of each text, given as runs of subwords closed by the end."""
        row = self.group_of[pieces]
        told = self.pairs + self.parameters["out_bias"]
        weights, p = np.exp(told), self.learned()
        begin, scored, context = windows(sizes)
        cut = segments(row, self.end_group)
        per_window = np.empty(len(begin))
        for i in range(0, len(begin), batch):
            own = slice(i, i + batch)
            got = log_probabilities(p, cut[begin[own]], context[own], told, self.class_of, weights, self.members)
            got[np.arange(SCORED)[None, :] >= scored[own, None]] = 0
            per_window[own] = got.sum(1, dtype=np.float64)
        if not len(sizes):
            return np.empty(0)
        text = np.repeat(np.arange(len(sizes)), -(-sizes // SCORED))
        rest = np.add.reduceat(self.inside[pieces], np.cumsum(sizes) - sizes)
        return (np.bincount(text, per_window, len(sizes)) + rest) / np.log(10)


def _parts(batches, most: int = 4 << 20, rows: int = 4000):
    """Record batches in parts of so many bytes of text and rows, or of one row."""
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        k = 0
        while k < batch.num_rows:
            end = min(max(k + 1, int(np.searchsorted(size, size[k] + most, "right")) - 1), k + rows, batch.num_rows)
            yield batch.slice(k, end - k)
            k = end


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different values of some arrays, and how often each is there."""
    row = np.concatenate([*parts, np.empty(0, np.int64)])
    parts.clear()
    row.sort()
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    return row[first], np.diff(np.append(first, len(row)))


def read_texts(docs: DataFrame, ranks) -> DataFrame:
    """Texts as numbers, and counts of those to learn from, in one reading of ``docs`` (doc_id, text, part).

    kind 0: (key, n) counts words by hash, END_WORD for ends; kind 1: (key, n) counts subwords by number; kind 3:
    (key, n) counts pairs of subwords, key the first times the size of the vocabulary plus the second; kind 2: chunks
    of all texts. Counts are of texts to learn from, not yet summed over tasks.
    """

    def counted(kind, key, n, most=50_000):
        for i in range(0, len(key), most):
            own = key[i : i + most]
            none = [pa.nulls(len(own), pa.binary())] * len(_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(np.asarray(own, np.int64)), pa.array(np.asarray(n[i : i + most], np.int64)), *none], ["kind", "key", "n", *_CHUNK])

    def run(batches):
        vocabulary = Vocabulary(ranks.value)
        pieces_n, met = np.zeros(vocabulary.size, np.int64), []
        pair_keys, pair_n = np.empty(0, np.int64), np.empty(0, np.int64)
        pairs_size = texts_n = 0

        def merged():
            keys, n = _counted(met)
            both, back = np.unique(np.concatenate([pair_keys, keys]), return_inverse=True)
            return both, np.bincount(back, np.concatenate([pair_n, n]), len(both)).astype(np.int64)

        for part in _parts(batches):
            ids = part.column("doc_id")
            chunk = Chunk(ids=ids.fill_null(0).to_numpy(), nulls=ids.is_null().to_numpy(zero_copy_only=False), parts=part.column("part").to_numpy(), **vocabulary.read(part.column("text")))
            none = [pa.nulls(1, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *none, *[pa.array([x], pa.binary()) for x in chunk.packed()]], ["kind", "key", "n", *_CHUNK])

            learned = chunk.parts == LEARNED
            words_n = np.bincount(chunk.words[np.repeat(learned, chunk.sizes)], minlength=len(chunk.hashes))
            used = np.flatnonzero(words_n)
            yield from counted(0, chunk.hashes[used], words_n[used])
            pieces, sizes = chunk.subwords(vocabulary.end, learned)
            pieces_n += np.bincount(pieces, minlength=vocabulary.size)
            # Before each text stands an end.
            met.append(np.concatenate([[vocabulary.end], pieces[:-1]]).astype(np.int64) * vocabulary.size + pieces)
            pairs_size += len(pieces)
            texts_n += len(sizes)
            if pairs_size > 2_000_000:
                pair_keys, pair_n = merged()
                pairs_size = 0
        some = np.flatnonzero(pieces_n)
        yield from counted(1, some, pieces_n[some])
        if met:
            pair_keys, pair_n = merged()
        yield from counted(3, pair_keys, pair_n)
        yield from counted(0, np.array([END_WORD]), np.array([texts_n]))

    return docs.select("doc_id", "text", "part").mapInArrow(run, "kind int, key long, n long, " + ", ".join(f"{k} binary" for k in _CHUNK))


def chunks_of(batches):
    """The chunks in record batches of their columns, each by itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk.unpacked([batch.column(k)[i].as_buffer() for k in _CHUNK])


def batches_of(chunk: Chunk, model: Model, number: int, rounds: int) -> list[tuple]:
    """The windows of a chunk's texts that round ``number`` learns from, mixed; each is in one of the rounds."""
    pieces, sizes = chunk.subwords(len(model.group_of) - 1, chunk.parts == LEARNED)
    begin, scored, context = windows(sizes)
    mixed = np.random.default_rng(SEED).permutation(len(begin))
    # Batches of a similar size, at least one for each round where there are as many windows.
    parts = np.array_split(mixed, max(min(rounds, len(mixed)), -(-len(mixed) // BATCH)))[number::rounds] if len(mixed) else []
    cut = segments(model.group_of[pieces].astype(np.int16), model.end_group)
    return [(cut[begin[x]], context[x], scored[x]) for x in parts]


def local_steps(parts, model: Model, number: int, rounds: int, passes: int = 1):
    """The parameters, times their weight, after a partition's steps in round ``number``; the weight is its windows of that round."""
    learner, kept, weight = Learner(model, RATE / (1 + number)), [], 0
    for chunk in chunks_of(parts):
        ready = batches_of(chunk, model, number, rounds)
        weight += sum(len(x) for x, *_ in ready)
        learner.learn(ready, number)
        if passes > 1:  # the whole corpus has few
            kept += ready
    for again in range(1, passes):
        learner.learn(kept, again * rounds + number)
    if weight:
        flat = learner.row.astype(np.float64) * weight
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), float(weight)))], ["i", "x", "w"])


def train(chunks: DataFrame, model: Model, subwords: float, rounds: int = ROUNDS) -> None:
    """Rounds of local steps and averages over chunks of so many ``subwords``; changes ``model``. Each window is in one round."""
    passes = max(1, min(PASSES, round(STEPS / max(1, subwords / (SCORED * BATCH)))))
    for number in range(rounds):
        sent = chunks.sparkSession.sparkContext.broadcast(model)

        def local(parts, sent=sent, number=number):
            yield from local_steps(parts, sent.value, number, rounds, passes)

        sums = chunks.mapInArrow(local, "i long, x double, w double").groupBy("i").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).toPandas()
        if len(sums):
            sums = sums.sort_values("i")
            learned = _unflatten((sums["x"] / sums["w"]).to_numpy(np.float32), model.learned())
            model.pick = learned.pop("pick")
            model.parameters = learned
        sent.unpersist()


def _pair_counts(counts: DataFrame, subword_counts: np.ndarray, groups: int = GROUPS) -> tuple:
    """(before, after, n) of pairs, with all subwords outside the most frequent ones written as one of those outside.

    At most ``groups`` squared rows, whatever the corpus.
    """
    size = len(subword_counts)
    order = np.argsort(-subword_counts, kind="stable")
    order = order[order != size - 1]
    frequent, other = [*order[: groups - 2].tolist(), size - 1], int(order[groups - 2]) if len(order) > groups - 2 else size - 1
    spark = counts.sparkSession
    known = F.broadcast(spark.createDataFrame([(int(x),) for x in frequent], "id long"))  # ``groups`` rows
    split = counts.where("kind = 3").select(F.floor(F.col("key") / size).alias("before"), F.pmod("key", F.lit(size)).alias("after"), "n")
    for side in ("before", "after"):
        split = split.join(known.withColumnRenamed("id", "_id"), F.col(side) == F.col("_id"), "left")
        split = split.withColumn(side, F.coalesce("_id", F.lit(other))).drop("_id")
    got = split.groupBy("before", "after").agg(F.sum("n").alias("n")).toPandas()
    return got["before"].to_numpy(np.int64), got["after"].to_numpy(np.int64), got["n"].to_numpy(np.float64)


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """(key, n) of at most ``most`` words: all that occur often enough, by a bound on n from a table of a few hundred rows."""
    step = F.floor(F.log2("n") * 8)
    below = 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        most -= r["words"]
        if most < 0:
            below = r["step"] + 1
            break
    return words.where(step >= below).select("key", "n")


def score_texts(docs: DataFrame, tokenizer: str | None = None, parts: int = 5, part: int = 1, rounds: int = ROUNDS, common: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32 of the id as text, modulo ``parts``, is not ``part``; the others are held out. Rows
    with a null id have no remainder: they are scored, not learned from and not held out. Null texts are empty: one
    token, the end. Without any training text every probability is that of the smoothing alone. Repeated rows are
    learned from and scored as often as they are there; an empty table gives no rows; other columns are ignored.
    base_score is that of single smoothed word counts, score that of the model. Texts are read whole.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, tokenizer))  # about a MB
    held = F.when(F.col("doc_id").isNull(), NEITHER).when(held_out(F.col("doc_id"), parts, part), HELD).otherwise(LEARNED)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.cast("byte").alias("part"))
    learned = save(read_texts(own, ranks))
    chunks = learned.where("kind = 2").select(*_CHUNK)
    counts = save(learned.where("kind <> 2").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"))
    words = counts.where("kind = 0")
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    n, v = n or 0, v or 0
    below = float(n + 0.5 * (v + 1))
    pieces = counts.where("kind = 1").toPandas()  # as many rows as the vocabulary of subwords at most
    sub = np.zeros(Vocabulary(ranks.value).size)
    sub[pieces["key"].to_numpy(np.int64)] = pieces["n"]
    model = Model(sub, _pair_counts(counts, sub))
    train(chunks, model, sub.sum(), rounds)
    top = _most_frequent(words, common).toPandas().sort_values("key")
    sent = spark.sparkContext.broadcast((model, top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def run(batches):
        model, keys, ns = sent.value

        def looked_up(h):
            """log10 of the smoothed share of words by hash, and whether they are among the most frequent."""
            if not len(keys):
                return np.zeros(len(h)), np.zeros(len(h), bool)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.log10((ns[at] + 0.5) / below), keys[at] == h

        for chunk in chunks_of(batches):
            sizes = chunk.sizes.astype(np.int64)
            scores = model.score(*chunk.subwords(len(model.group_of) - 1))
            # Each word and, for each text, the end: a further word of the chunk's.
            h = np.append(chunk.hashes, END_WORD)
            share, met = looked_up(h)
            text = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.arange(len(sizes))])
            word = np.concatenate([chunk.words, np.full(len(sizes), len(h) - 1)])
            there = met[word]
            base = np.bincount(text[there], share[word[there]], len(sizes)).astype(np.float64)  # of nothing, integers
            known = np.bincount(text[there], minlength=len(sizes))
            rare, times = np.unique(text[~there] * len(h) + word[~there], return_counts=True)
            bounds = np.searchsorted(rare, np.arange(len(sizes) + 1) * len(h))
            rest = pa.StructArray.from_arrays([pa.array(h[rare % len(h)]), pa.array(times.astype(np.int64))], ["h", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.ids, mask=chunk.nulls), pa.array(chunk.parts == HELD), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(scores),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rest),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<h:long,n:long>>"
    scored = save(chunks.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    drop(learned)
    # Words that are not among the most frequent: their counts are joined.
    rest = (
        scored.select("row", F.explode("rest").alias("r"))
        .select("row", F.col("r.h").alias("key"), F.col("r.n").alias("times"))
        .join(words.select("key", F.col("n").alias("c")), "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / below)).alias("base2"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("known2"),
        )
    )
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learned from those whose remainder is not 1."""
    return score_texts(read(spark, sf_dir, "documents"))
