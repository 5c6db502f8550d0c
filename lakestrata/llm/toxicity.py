"""Toxicity of texts that may be written to escape a word list.

A noisy channel: the writer meant letters, and the reader sees look-alikes, repetitions, and separators
between letters. Each suspicious token becomes a lattice of what every character may stand for, and the
Viterbi path under a character trigram model of the whole corpus restores it. A token of plain letters
has one path only, itself, and is not decoded. A logistic model then scores the restored words by
whole words and word beginnings that its training documents tie to the label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.sample import PER_LABEL, fold, training_sample
from lakestrata.llm.shared import Memo, per_batch, raw

CUT = 0.3
FOLDS, HELD = 4, 2
FEATURES = 512  # features in the model, the strongest of all that the sample has
WIDTH = 28  # edge of a word, a to z, any other letter

# What a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(" .-_*~'^,:;/\\")
LOOK_COST, DROP_COST, KEEP_COST, SQUEEZE_COST = 0.7, 0.4, 6.0, 0.4

_LETTERS = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_LOOKS = "".join(map(re.escape, LOOKALIKES))
_SIGN = rf"[{_LOOKS}]|[^\W\d_]"  # what may be a letter
_HIDDEN = re.compile(rf"[{_LOOKS}]|(?:{_SIGN})[\s.\-_*~'^,:;/\\]+(?:{_SIGN})|([^\W\d_])\1")
_TWICE = re.compile(r"([^\W\d_])\1")
_EDGE_NOISE = re.compile(r"^[^\w\s]+|[^\w\s]+$")
_EDGE_SEPARATORS = "".join(sorted(SEPARATORS))
#: What characters may stand for, as one sign for all that may be the same letter; separators go.
_FOLDED = {c: x[0] for c, x in LOOKALIKES.items()} | {c: "" for c in SEPARATORS} | {"l": "i", "£": "i"}
_FOLD = str.maketrans(_FOLDED)
#: Letters and marks behind them that stand for no letter; the letters, if they are one word, are all that such a token can mean.
_PLAIN = re.compile(rf"([^\W\d_]+)[^\w\s{_LOOKS}]*").fullmatch
_REPEAT = re.compile(r"(.)\1+", re.S)
_REPEAT_WITHIN = re.compile(r"([^\n])\1+")
_DRAWN_OUT = re.compile(r"(.)\1{2,}", re.S)
#: Signs that a word may begin behind: behind a separator that another one follows it begins later.
_WORD_MAY_FOLLOW = re.compile(rf"[\W\d_](?={_SIGN})")


def _codes() -> np.ndarray:
    """Byte to code: 0 is an edge, -1 the rest of a character of several bytes."""
    table = np.zeros(256, np.int16)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[128:192] = -1
    table[192:] = 27
    return table


CODES = _codes()


def trigram_counts(data: bytes) -> np.ndarray:
    """How often each three codes follow each other; edges in a row are one."""
    codes = CODES[np.frombuffer(data, np.uint8)]
    codes = np.concatenate([[0], codes[codes >= 0], [0, 0]]).astype(np.int64)
    codes = np.concatenate([codes[:1], codes[1:][(codes[1:] > 0) | (codes[:-1] > 0)]])
    if len(codes) < 3:
        return np.zeros(WIDTH**3, np.int64)
    return np.bincount((codes[:-2] * WIDTH + codes[1:-1]) * WIDTH + codes[2:], minlength=WIDTH**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log chances) of a code after two codes, from every text of ``docs``.

    Each task adds up its own texts, so at most WIDTH**3 sums leave it, and as many reach the driver.
    """

    def count(batches):
        total = np.zeros(WIDTH**3, np.int64)
        for batch in batches:
            # One pass for some texts at a time: a break between two texts is an edge.
            some, size = [], 0
            for text in raw(batch, "text"):
                some.append(text or b"")
                size += len(some[-1])
                if size > 1 << 18:
                    total += trigram_counts(b" ".join(some))
                    some, size = [], 0
            total += trigram_counts(b" ".join(some))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sums = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(WIDTH**3)
    for r in sums:
        counts[r["at"]] = r["n"]
    cube = counts.reshape(WIDTH, WIDTH, WIDTH)
    pair = cube.sum(0) + 1.0  # what follows one code
    back = pair / pair.sum(1, keepdims=True)
    chance = (cube + 5 * back[None]) / (cube.sum(2, keepdims=True) + 5)
    return -np.log(chance)


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


#: Codes of what a place may stand for.
_MEANT = Memo(lambda meant: tuple(map(_code, meant)), 10_000)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of the token what it may stand for, with costs; "" drops the place."""
    places = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if c.isalpha():
            # A letter twice may be meant or drawn out; more of them are one or two.
            places.append([(c * 2, 0.0), (c, SQUEEZE_COST)] if n == 2 else [(c, SQUEEZE_COST), (c * 2, SQUEEZE_COST)] if n > 2 else [(c, 0.0)])
        elif c in LOOKALIKES:
            # Several of them may be one letter drawn out, or a letter each; three or more are kept at the cost of one.
            meant = [(x, LOOK_COST) for x in LOOKALIKES[c]] + [(c, KEEP_COST if n < 3 else KEEP_COST / n)]
            places += [meant] + [meant + [("", SQUEEZE_COST)]] * (n - 1)
        elif c in SEPARATORS:
            places.append([("", DROP_COST), (" ", KEEP_COST)])
        else:
            places.append([(c * n, 0.0)])
    return places


def decode(token: str, costs: np.ndarray | list) -> str:
    """The cheapest path of the lattice: channel costs and trigram costs together; ties to the smaller text.

    ``costs`` may be nested lists, which are read faster than an array.
    """
    states, codes = {(0, 0): (0.0, "")}, _MEANT
    for options in [*lattice(token), [(" ", 0.0)]]:
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for meant, extra in options:
                x, y, total = a, b, cost + extra
                for z in codes[meant]:
                    if z or y:
                        total += costs[x][y][z]
                        x, y = y, z
                new = (total, text + meant)
                if (x, y) not in reached or new < reached[x, y]:
                    reached[x, y] = new
        states = reached
    return min(states.values())[1].rstrip()


def suspicious(token: str) -> bool:
    """Whether a token with a letter also has a look-alike, a separator between two signs, or a letter twice in a row."""
    return bool(_LETTER.search(token) and _HIDDEN.search(token))


def restored_words(token: str, costs: np.ndarray, worth: Callable[[str], bool] = suspicious) -> list[str]:
    """Words of letters that a lower-case token holds before and after it is restored, if that is ``worth`` it."""
    if token.isalpha() and not _TWICE.search(token):
        return [token]
    words = _LETTERS.findall(token)
    # A look-alike at an edge may be a letter or a mark, so the token is read with its edges and without.
    for form in dict.fromkeys((token, _EDGE_NOISE.sub("", token))):
        if worth(form):
            words += [w for w in _LETTERS.findall(decode(form, costs)) if w not in words]
    return words


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if n <= len(word))]


def folded(token: str) -> str:
    """A token as the signs it may stand for: every spelling that the lattice can restore to a word folds like the word."""
    return _REPEAT.sub(r"\1", token.translate(_FOLD))


def is_single(word: str) -> bool:
    """Whether a word is one sign, which separators may follow or precede."""
    return len(word) == 1 or len(word) < 4 and len(word.strip(_EDGE_SEPARATORS)) == 1


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more single signs as one token with blanks."""
    return joined_runs(words, [i for i, w in enumerate(words) if is_single(w)])


def joined_runs(words: list[str], single: list[int]) -> list[str]:
    """Three or more of the given places that follow each other, as one token with blanks."""
    if len(single) < 3:
        return []
    runs, run = [], []
    for i in single:
        if run and i != run[-1] + 1:
            runs.append(run)
            run = []
        run.append(i)
    runs.append(run)
    return [" ".join(words[i] for i in r) for r in runs if len(r) > 2]


class Finder:
    """Features of texts: those in ``known`` as their places, or all as names when ``known`` is None.

    Blanks may split a word anywhere. Neighbours that fold like a known whole word are decoded together; no others
    can restore to one. Nothing is decoded that can only mean features already found.
    """

    def __init__(self, costs: np.ndarray, known: dict[str, int] | None = None):
        self.costs, self.known = np.asarray(costs).tolist(), known
        # What tokens give, in two halves of which the older one goes when the newer one is full.
        self.newer, self.older, self.limit = {}, {}, 100_000
        self.whole = {folded(f[1:]) for f in known or () if f[0] == "="}
        self.starts = {f[:n] for f in self.whole for n in range(1, len(f) + 1)}
        self.prefixes = {folded(f[1:]) for f in known or () if f[0] == "^"}
        self.heads = {f[:3] for f in self.prefixes}
        self.lengths = sorted({len(f) for f in self.prefixes})
        self.longest = max(map(len, self.prefixes | self.whole), default=0)
        self.pairs, self.joined, self.folds = Memo(folded, 10_000), Memo(self._token, 10_000), Memo(self._folds, 20_000)
        # What tells the known features of a word of letters: whole words, and beginnings by their first three letters.
        self.words = {f[1:]: i for f, i in (known or {}).items() if f[0] == "="}
        self.begins = {f[1:]: i for f, i in (known or {}).items() if f[0] == "^"}
        self.openings = {f[:3] for f in self.begins}
        self.sizes = sorted({len(f) for f in self.begins})
        self.squeezed: dict[tuple[str, str], set[int]] = {}  # the same by kind and letters, no letter twice in a row
        for f, i in (known or {}).items():
            self.squeezed.setdefault((f[0], _REPEAT.sub(r"\1", f[1:])), set()).add(i)
        self.short = sorted({len(f) for kind, f in self.squeezed if kind == "^"})
        # Letters that may follow a beginning of a whole word.
        after: dict[str, set[str]] = {f: {f[-1]} for f in self.starts}
        for f in self.starts:
            if f[:-1]:
                after[f[:-1]].add(f[-1])
        self.after = {f: frozenset(s | {"l"} if "i" in s else s) for f, s in after.items()}
        self.under = Memo(self._within, 10_000)
        self.shared: dict[tuple, tuple] = {}

    def _worth(self, token: str) -> bool:
        """Whether decoding may find a known feature."""
        return suspicious(token) and (self.known is None or self._may_hold(token, folded(token) if token.isalpha() else ""))

    def _within(self, flat: str) -> frozenset:
        """Every known feature that a token which folds to ``flat`` may mean: what it restores to folds like a part of it."""
        return frozenset(i for f, i in self.known.items() if folded(f[1:]) in flat)

    def _folds(self, word: str) -> tuple:
        """How a word folds, and how without marks at its edges if that differs."""
        return tuple(dict.fromkeys((folded(word), folded(_EDGE_NOISE.sub("", word)))))

    def _plain(self, token: str, letters: str, flat: str) -> tuple:
        """What ``_value`` gives for ``letters``, which fold to ``flat``, and marks behind them that stand for no letter.

        Such a token means its letters, of which any that stands there twice may be one. It is decoded
        only if that could give other features than the letters have as they are.
        """
        hits = [self.words[letters]] if letters in self.words else []
        if letters[:3] in self.openings:
            hits += [self.begins[f] for n in self.sizes if n <= len(letters) and (f := letters[:n]) in self.begins]
        if len(flat) < len(letters) and _TWICE.search(letters):
            once = _REPEAT.sub(r"\1", letters)
            may = self.squeezed.get(("=", once), set()).union(*(self.squeezed.get(("^", once[:n]), ()) for n in self.short if n <= len(once)))
            if not may.issubset(hits):
                hits = self._token(token)
        begun = (flat,) if flat in self.starts else ()
        single = len(token) < 4 and is_single(token)
        if not (hits or begun or single):
            return ()
        value = (tuple(sorted(hits)), begun, single)
        return self.shared.setdefault(value, value)

    def _may_hold(self, token: str, flat: str) -> bool:
        """Whether a token, which folds to ``flat`` if it is all letters, can mean a word with a known feature.

        What it can mean folds like it. A word begins where the token does or behind a sign that is no letter, and it ends
        before such a sign or with the token; all letters are one word.
        """
        if token.isalpha():
            heads = self.heads
            known = flat[:3] in heads or flat[:2] in heads or flat[:1] in heads
            return flat in self.whole or known and any(flat[:n] in self.prefixes for n in self.lengths)
        short = _DRAWN_OUT.sub(r"\1\1", token)  # folds alike
        kept = [(i, s) for i, c in enumerate(short) if (s := _FOLDED.get(c, c))]
        other = [len(kept)] * len(kept)  # where the next different sign stands
        for k in range(len(kept) - 2, -1, -1):
            other[k] = k + 1 if kept[k + 1][1] != kept[k][1] else other[k + 1]
        marks = list(accumulate((not c.isalpha() for c in short), initial=0))
        k = 0
        for place in (0, *(m.end() for m in _WORD_MAY_FOLLOW.finditer(short))):
            while k < len(kept) and kept[k][0] < place:
                k += 1
            text, j = "", k
            while j < len(kept) and len(text) < self.longest:
                text, after = text + kept[j][1], other[j]
                if text in self.prefixes or text in self.whole and (after == len(kept) or marks[kept[after][0] + 1] > marks[kept[j][0] + 1]):
                    return True
                j = after
        return False

    def _begun(self, token: str, flat: str) -> tuple:
        """The forms of a token, as it is and without marks at its edges, that begin a known whole word."""
        if not self.starts:
            return ()
        bare = token.strip(_EDGE_SEPARATORS)  # which fold to nothing
        if bare and bare[0].isalnum() and bare[-1].isalnum():
            return (flat,) if flat in self.starts else ()
        if bare[:2].isalpha() and len(head := self.pairs[bare[:2]]) == 2 and head not in self.starts:
            return ()
        return tuple(f for f in {flat, folded(_EDGE_NOISE.sub("", token))} if f in self.starts)

    def _token(self, token: str) -> tuple:
        """Places of the known features of a token; its words if all features count."""
        words = restored_words(token, self.costs, self._worth)
        return tuple(words) if self.known is None else tuple(sorted({self.known[f] for w in words for f in word_features(w) if f in self.known}))

    def _value(self, token: str, flat: str) -> tuple:
        """Features of a token that folds to ``flat``, the forms in which it may begin a word that blanks split, and whether it is a single sign.

        () if nothing of it counts: what a token can mean folds like it from a place on where a word may begin.
        """
        single = len(token) < 4 and is_single(token)
        if self.known is None:
            return self._token(token), (), single
        begun = self._begun(token, flat)
        may = self._may_hold(token, flat)
        hits = self._token(token) if may else ()
        return (hits, begun, single) if hits or begun or single else ()

    def _learn(self, tokens: list[str]) -> None:
        """Values of tokens that the newer half lacks; all of them are folded in one go."""
        if len(self.newer) > self.limit:
            self.newer, self.older, self.shared = {}, self.newer, {}
        newer, older = self.newer, self.older
        if self.known is None:
            newer.update((t, older[t] if t in older else self._value(t, "")) for t in tokens)
            return
        for token in (again := older.keys() & tokens):
            newer[token] = older[token]
        some, letters = [], []
        for token in tokens:
            if token in again:
                continue
            if token.isalpha():
                some.append(token)
                letters.append(token)
            elif (m := _PLAIN(token)) and m[1].isalpha():
                some.append(token)
                letters.append(m[1])
            else:
                newer[token] = self._value(token, folded(token))
        heads, starts, words, plain = self.openings, self.starts, self.words, self._plain
        # Letters fold like themselves but for l.
        flats = _REPEAT_WITHIN.sub(r"\1", "\n".join(letters).replace("l", "i")).split("\n")
        for token, word, flat in zip(some, letters, flats):
            if len(flat) == len(word) > 1 and word[:3] not in heads and flat not in starts and word not in words:
                newer[token] = ()  # most tokens
            else:
                newer[token] = plain(token, word, flat)

    def _split(self, words: list[str], begun: list[tuple[int, tuple]], found: set) -> set[str]:
        """Neighbours that fold like a known whole word, as one token with blanks, from the places where one may begin.

        Those that can only mean features in ``found`` are left out, and not looked at one by one where the
        same word stands again and again.
        """
        runs, after, ends = set(), self.after, None
        for i, forms in begun:
            flat = self.folds[words[i]][0]
            j = i + 1
            while j < len(words):
                if (c := words[j][0]).isalpha():
                    forms = [a for a in forms if c in after[a]]
                    if not forms:
                        break
                folds, old, before = self.folds[words[j]], flat, forms
                flat += folds[0][folds[0][:1] == flat[-1:] :] if flat else folds[0]
                done = True
                if folds != ("",):
                    forms = {f for a in forms for b in folds if (f := a + b[b[:1] == a[-1] :]) in self.starts}
                    if not self.whole.isdisjoint(forms):
                        done = (self.under[flat] if len(flat) < 64 else self._within(flat)) <= found
                        if not done:
                            runs.add(" ".join(words[i : j + 1]))
                    if not forms:
                        break
                if done and flat == old and len(forms) == len(before) and set(forms) == set(before) and j + 1 < len(words) and words[j + 1] == words[j]:
                    # The same word once more changes nothing.
                    if ends is None:
                        ends = [len(words)] * len(words)
                        for k in range(len(words) - 2, -1, -1):
                            ends[k] = ends[k + 1] if words[k] == words[k + 1] else k + 1
                    j = ends[j]
                else:
                    j += 1
        return runs

    def __call__(self, text: str) -> set:
        words = text.lower().split()
        seen = set(words)
        while new := seen.difference(self.newer):  # twice if some of them go with the older half
            self._learn(list(new))
        if self.known is None:
            names = {f for w in seen for f in self.newer[w][0]}
            for token in joined_runs(words, [i for i, w in enumerate(words) if self.newer[w][2]]):
                names.update(self.joined[token])
            return {f for w in names for f in word_features(w)}
        found: set = set()
        opening = {}  # words that may begin a split word, and single signs
        for word in seen:
            if value := self.newer[word]:
                hits, begun, single = value
                found.update(hits)
                if begun or single:
                    opening[word] = value
        places = [(i, opening[w]) for i, w in enumerate(words) if w in opening]
        tokens = self._split(words, [(i, v[1]) for i, v in places if v[1]], found)
        for token in joined_runs(words, [i for i, v in places if v[2]]):
            if token in self.joined or not self._within(folded(token)) <= found:
                tokens.add(token)
        for token in tokens:
            found.update(self.joined[token])
        return found


class Model(NamedTuple):
    costs: np.ndarray
    known: dict[str, int]
    weights: np.ndarray
    intercept: float


def _fit(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic weights with a ridge on all but the last, the intercept."""
    x = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], 1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ x + np.diag(keep), x.T @ (p - target) + keep * w)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The character model from all of ``docs``; weights from at most ``per_label`` labelled documents of each label.

    Labels of the held-out fold are not read. Without any toxic training document every score is 0.
    """
    costs = language_model(docs)
    sample, counts = training_sample(docs, labels, "toxic", FOLDS, HELD, per_label)
    used = {0: min(per_label, counts[0]), 1: min(per_label, counts[1])}
    if not counts[0] or not counts[1]:
        return Model(costs, {}, np.zeros(0), 30.0 if counts[1] else -30.0)

    def tally(batches):
        find = Finder(costs)
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "label", "n"])

        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                seen.update((f, label) for f in find(text or ""))
                if len(seen) > 60_000:
                    yield out()
        if seen:
            yield out()

    n0, n1 = float(used[0]), float(used[1])
    by_label = sample.select("text", "label").mapInArrow(tally, "feature string, label int, n long").groupBy("feature")
    sums = by_label.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    # How far apart the label's documents are in having the feature, in standard errors; only signs of the label count.
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (n1 - F.col("a") + 0.5) + 1 / (n0 - F.col("b") + 0.5))
    strong = sums.where("a >= 2").withColumn("z", odds / error).where("z > 1.5").orderBy(F.desc("z"), "feature").limit(FEATURES)
    known = {r["feature"]: i for i, r in enumerate(sorted(strong.collect(), key=lambda r: r["feature"]))}

    def make():
        find = Finder(costs, known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = [sorted(find(t or "")) for t in batch["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["label"], pa.array(hits, pa.list_(pa.int32()))], ["label", "hits"])

        return step

    # A row per distinct set of features and label: far fewer than documents.
    rows = per_batch(sample.select("text", "label"), make, "label int, hits array<int>").collect()
    x = np.zeros((len(rows), len(known)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["hits"]] = 1
    w = _fit(x, np.array([r["label"] for r in rows], float))
    # The sample has the labels in other shares than all training rows.
    shift = math.log(counts[1] / used[1]) - math.log(counts[0] / used[0])
    return Model(costs, known, w[:-1], float(w[-1]) + shift)


def _scores(model: Model, find: Finder, batch: pa.RecordBatch) -> np.ndarray:
    z = [model.intercept + float(model.weights[sorted(find(t or ""))].sum()) for t in batch["text"].to_pylist()]
    return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row. A null text is empty; repeated rows score alike; other columns are ignored."""

    def make():
        find = Finder(model.costs, model.known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(model, find, batch))], ["doc_id", "score"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score below the threshold, all columns unchanged."""

    def make():
        find = Finder(model.costs, model.known)
        return lambda batch: batch.filter(pa.array(_scores(model, find, batch) < CUT))

    return per_batch(docs, make, docs.schema)


def held_out():
    return fold(FOLDS) == HELD
