"""Spelling variants: words one edit apart, found by k-d trees over their letter counts, and the form each stands for.

One edit changes the letter counts of a word by at most two in all: an
insertion adds one letter, a replacement takes one and adds another. So the
words of a length form a k-d tree over count vectors, and every word searches
the tree of its own length (one letter less, one more) and that of the next
length (one letter more), entering only cells that many steps away. What is
left is checked letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import written

LETTERS = "[A-Za-zÀ-ÿ]+"
DIMENSIONS = 26 + 64
#: Words of a length that share a cell, and so a task's tree; more are cut by the upper levels of the length's tree.
CELL_WORDS = 16_384
#: Cells of a length at most; past that they grow. The sample that places the cuts is SAMPLE words for each cell.
MOST_CELLS = 4096
SAMPLE = 32
LEAF = 32
PAIRS_AT_ONCE = 1 << 20
PROBES_AT_ONCE = 1 << 15


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 6, least_count: int = 5, typo_every: int = 199) -> DataFrame:
    """(word, n): the words of all texts, A-Z lowered, with their number of occurrences.

    A run of letters is a word. To have variants to find, the run of a document
    whose crc32 of ``doc_id:run`` is a multiple of ``typo_every`` loses one
    letter, wherever it stands in that document; 0 leaves all as they are. A
    null text has no words, a null doc_id counts as empty. Counted on the map
    side first, so a frequent word is one row per task.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), upper, upper.lower()), F.lit(LETTERS), F.lit(0))).alias("word"),
    )
    if typo_every:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        cut = (h % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.length("word")))
        found = found.select(F.when(h % typo_every == 0, shorter).otherwise(F.col("word")).alias("word"))
    counted = found.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def letters_of(words: list[str], length: int) -> np.ndarray:
    """A row of letter codes per word; all have ``length`` letters, none beyond U+00FF."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Count vectors: a to z, then U+00C0 to U+00FF."""
    place = np.where(codes >= 0xC0, codes.astype(np.int64) - (0xC0 - 26), codes.astype(np.int64) - ord("a"))
    flat = (np.arange(len(codes))[:, None] * DIMENSIONS + place).ravel()
    counts = np.bincount(flat, minlength=len(codes) * DIMENSIONS).reshape(len(codes), DIMENSIONS)
    return counts.astype(np.int8 if codes.shape[1] < 128 else np.int32)


class CountTree:
    """K-d tree over count vectors: each split asks whether one letter's count is over a bound.

    ``search`` finds, for words that may gain one letter and may lose one, the
    leaves they can reach. A word crosses to the far side of a split only if
    one more (or one less) of that letter takes it there, and only once each
    way: the distance to the box behind the split is then one step of two.
    """

    def __init__(self, counts: np.ndarray, leaf: int, most_leaves: int | None = None) -> None:
        self.splits: list[tuple[int, int, int, int]] = []  # letter, bound, left, right; a child below zero is leaf ~child
        self.leaves: list[np.ndarray] = []
        self.leaf = leaf if most_leaves is None else max(leaf, -(-len(counts) // most_leaves))
        self.root = self._grow(counts, np.arange(len(counts)))

    def _grow(self, counts: np.ndarray, rows: np.ndarray) -> int:
        cut = self._cut(counts, rows) if len(rows) > self.leaf else None
        if cut is None:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        letter, bound = cut
        over = counts[rows, letter] > bound
        at = len(self.splits)
        self.splits.append((letter, bound, 0, 0))
        self.splits[at] = (letter, bound, self._grow(counts, rows[~over]), self._grow(counts, rows[over]))
        return at

    @staticmethod
    def _cut(counts: np.ndarray, rows: np.ndarray) -> tuple[int, int] | None:
        """The letter and bound that part the rows most evenly; None if all vectors are equal."""
        some = counts[rows[:: max(1, len(rows) // 2048)]]
        best = None
        for bound in range(4):
            share = np.abs((some > bound).mean(axis=0) - 0.5)
            letter = int(share.argmin())
            if share[letter] < 0.5 and (best is None or share[letter] < best[0]):
                best = (float(share[letter]), letter, bound)
        if best is not None:
            return best[1:]
        first = counts[rows[0]]
        differs = np.flatnonzero((counts[rows] != first).any(axis=0))
        if not len(differs):
            return None
        column = counts[rows, differs[0]]
        return int(differs[0]), int((int(column.min()) + int(column.max())) // 2)

    def search(self, counts: np.ndarray, lose: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows that reach it). Each row gains one letter; with ``lose`` it also loses an earlier one.

        Of two words of a length, one gains the later letter of the two that
        differ, so only that one finds the other.
        """
        none = np.full(len(counts), -1, np.int8)
        todo = [(self.root, np.arange(len(counts)), none, none)]
        while todo:
            node, rows, up, down = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            letter, bound, left, right = self.splits[node]
            has = counts[rows, letter].astype(np.int32) + (up == letter) - (down == letter)
            over = has > bound
            for child, stay, step in ((left, ~over, -1), (right, over, 1)):
                if step > 0:
                    cross = ~stay & (has == bound) & (up < 0) & (down < letter)
                else:
                    cross = ~stay & (has == bound + 1) & (down < 0) & ((up < 0) | (up > letter)) if lose else np.zeros(len(rows), bool)
                new_up, new_down = (up[cross], down[cross]) if step else (None, None)
                moved = np.full(int(cross.sum()), letter, np.int8)
                new_up, new_down = (moved, new_down) if step > 0 else (new_up, moved)
                todo.append((
                    child, np.concatenate([rows[stay], rows[cross]]), np.concatenate([up[stay], new_up]), np.concatenate([down[stay], new_down]),
                ))

    def homes(self, counts: np.ndarray) -> np.ndarray:
        """The leaf each vector itself lies in."""
        out = np.zeros(len(counts), np.int64)
        todo = [(self.root, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                letter, bound, left, right = self.splits[node]
                over = counts[rows, letter] > bound
                todo += [(left, rows[~over]), (right, rows[over])]
        return out


#: Any step of one letter lost and one gained changes a word's sum of weights by one of these differences.
_WEIGHTS = np.random.default_rng(12).integers(1, 1 << 62, DIMENSIONS, np.int64).astype(np.uint64)
_SIEVE_BITS = 20


def _sieve(steps: np.ndarray) -> np.ndarray:
    spots = np.zeros(1 << _SIEVE_BITS, bool)
    spots[(steps >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return spots


_GAINS = _WEIGHTS
_SWAPS = (_WEIGHTS[None, :] - _WEIGHTS[:, None])[np.triu_indices(DIMENSIONS, 1)]
_SIEVES = {True: _sieve(_SWAPS), False: _sieve(_GAINS)}


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart, their counts being a step apart; ``long`` is as long or one letter longer."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    before = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= n


class CellWords:
    """The words of one cell as a tree of distinct count vectors, each with its words."""

    def __init__(self, words: list[str]) -> None:
        self.codes = letters_of(words, len(words[0]))
        counts = letter_counts(self.codes)
        self.vectors, kind = np.unique(counts, axis=0, return_inverse=True)
        self.order = np.argsort(kind.ravel(), kind="stable")
        self.starts = np.searchsorted(kind.ravel()[self.order], np.arange(len(self.vectors) + 1))
        self.sums = self.vectors.astype(np.uint64) @ _WEIGHTS
        self.tree = CountTree(self.vectors, LEAF)

    def near(self, words: list[str], lose: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``words``, rows of the cell) one edit apart, part by part."""
        codes = letters_of(words, len(words[0]))
        counts = letter_counts(codes)
        vectors, kind = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        starts = np.searchsorted(kind.ravel()[order], np.arange(len(vectors) + 1))
        sums = vectors.astype(np.uint64) @ _WEIGHTS
        sieve = _SIEVES[lose]
        for leaf, rows in self.tree.search(vectors, lose):
            there = self.tree.leaves[leaf]
            for lo in range(0, len(rows), 1 << 14):
                part = rows[lo : lo + (1 << 14)]
                step = self.sums[there][None, :] - sums[part][:, None]
                a, b = np.nonzero(sieve[(step >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
                a, b = part[a], there[b]
                change = self.vectors[b].astype(np.int32) - vectors[a]
                right = (np.abs(change).sum(axis=1) == (2 if lose else 1)) & (change.sum(axis=1) == (0 if lose else 1))
                if lose:  # the one that gains the later letter finds the other
                    right &= change.argmax(axis=1) > change.argmin(axis=1)
                yield from self._spelled(codes, order, starts, a[right], b[right])

    def _spelled(self, codes, order, starts, a, b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of words among pairs of vectors a step apart."""
        na, nb = starts[a + 1] - starts[a], self.starts[b + 1] - self.starts[b]
        sizes = na * nb
        for i in np.flatnonzero(sizes > PAIRS_AT_ONCE):
            yield self._crowded(codes, order[starts[a[i]] : starts[a[i] + 1]], self.order[self.starts[b[i]] : self.starts[b[i] + 1]])
        small = np.flatnonzero((sizes > 0) & (sizes <= PAIRS_AT_ONCE))
        parts = np.cumsum(sizes[small]) // PAIRS_AT_ONCE
        for part in np.split(small, np.flatnonzero(np.diff(parts)) + 1):
            if not len(part):
                continue
            at = np.repeat(np.arange(len(part)), sizes[part])
            inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            left = order[starts[a[part]][at] + inner // nb[part][at]]
            right = self.order[self.starts[b[part]][at] + inner % nb[part][at]]
            good = one_edit(codes[left], self.codes[right])
            yield left[good], right[good]

    def _crowded(self, codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for two large groups of anagrams, without trying all pairs: by what is left when a letter is masked or taken out."""
        same = codes.shape[1] == self.codes.shape[1]
        first: dict[tuple[int, bytes], list[int]] = {}
        for row in left:
            word = codes[row].tobytes()
            for p in range(len(word)) if same else (-1,):
                first.setdefault((p, word[:p] + word[p + 1 :]) if same else (0, word), []).append(row)
        pairs = set()
        for row in right:
            word = self.codes[row].tobytes()
            for p in range(len(word)):
                for other in first.get((p if same else 0, word[:p] + word[p + 1 :]), ()):
                    pairs.add((other, row))
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _upper_trees(words: DataFrame) -> dict[int, CountTree]:
    """For lengths with more than CELL_WORDS words: the upper levels of their tree, cut by the medians of a sample.

    The sample is by hash and has SAMPLE words per wanted cell, 131,072 of a
    length at most. It places the cuts; every word is filed and searched.
    """
    sizes = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > CELL_WORDS).collect()
    trees = {}
    wanted = {r["length"]: min(MOST_CELLS, -(-r["count"] // CELL_WORDS)) for r in sizes}
    if not wanted:
        return trees
    shares = words.sparkSession.createDataFrame(
        [Row(length=r["length"], cut=int(min(1.0, 1.2 * SAMPLE * wanted[r["length"]] / r["count"]) * (1 << 30))) for r in sizes], "length int, cut long",
    )
    picked = words.select("word", F.length("word").alias("length")).join(F.broadcast(shares), "length").where(
        F.xxhash64("word").bitwiseAND((1 << 30) - 1) <= F.col("cut")
    ).select("length", "word").toPandas()
    for length, group in picked.groupby("length"):
        counts = letter_counts(letters_of(group["word"].tolist(), int(length)))
        trees[int(length)] = CountTree(counts, 1, wanted[int(length)])
    for tree in trees.values():
        tree.leaves = [None] * len(tree.leaves)
    return trees


_FILED = pa.schema([("cell", pa.int64()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def _filed(words: DataFrame) -> DataFrame:
    """(cell, kind, word, n): each word in its own cell (kind 0), and at every cell it must search, of its length (1) or the next (2)."""
    trees = _upper_trees(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for length, group in frame.groupby(frame["word"].str.len()):
                length = int(length)
                own, n = group["word"].to_numpy(object), group["n"].to_numpy(np.int64)
                counts = letter_counts(letters_of(list(own), length)) if length in trees or length + 1 in trees else None
                parts = []
                every = np.arange(len(own))
                if length in trees:
                    parts.append((0, every, trees[length].homes(counts)))
                    parts += [(1, rows, leaf) for leaf, rows in trees[length].search(counts, True)]
                else:
                    parts += [(0, every, 0), (1, every, 0)]
                if length + 1 in trees:
                    parts += [(2, rows, leaf) for leaf, rows in trees[length + 1].search(counts, False)]
                else:
                    parts.append((2, every, 0))
                for kind, rows, leaf in parts:
                    cells = (length + (kind == 2)) * MOST_CELLS * 2 + np.broadcast_to(leaf, len(rows))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cells.astype(np.int64)), pa.array(np.full(len(rows), kind, np.int8)), pa.array(own[rows], pa.string()), pa.array(n[rows]),
                    ], schema=_FILED)

    return words.select("word", "n").mapInArrow(run, "cell long, kind byte, word string, n long")


_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n) one inserted, deleted or replaced letter apart, once.

    ``words`` are distinct and of letters up to U+00FF, A-Z lowered. The cells
    of the trees are shuffled, not broadcast, as they grow with the vocabulary;
    a task keeps one cell's words and streams those that search it.
    """
    dealt = _filed(words).repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, tree, waiting = None, [], None, []

        def searched() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if not (held and waiting):
                waiting.clear()
                return
            members = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held[:] = [members]
            tree = tree or CellWords(members["word"].tolist())
            probes = pd.concat(waiting, ignore_index=True)
            waiting.clear()
            names, sizes = members["word"].to_numpy(object), members["n"].to_numpy(np.int64)
            for kind, group in probes.groupby("kind"):
                words_, n = group["word"].to_numpy(object), group["n"].to_numpy(np.int64)
                for left, right in tree.near(list(words_), kind == 1):
                    if len(left):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(words_[left], pa.string()), pa.array(n[left]), pa.array(names[right], pa.string()), pa.array(sizes[right]),
                        ], schema=_PAIRS)

        for batch in batches:
            frame = batch.to_pandas()
            for key, group in frame.groupby("cell", sort=True):
                if key != cell:
                    yield from searched()
                    cell, held, tree, waiting = key, [], None, []
                kinds = group["kind"].to_numpy()
                if (kinds == 0).any():
                    held.append(group[kinds == 0])
                if (kinds > 0).any():
                    waiting.append(group[kinds > 0])
                    if sum(map(len, waiting)) >= PROBES_AT_ONCE:
                        yield from searched()
        yield from searched()

    return dealt.mapInArrow(run, "a string, a_n long, b string, b_n long")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words`` (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the one of largest n
    among them (ties: smallest in code-point order) if its n is at least
    ``times`` that of the word, else null; ``root`` is where following forms
    ends. As counts grow fivefold with every form, there are no circles, and
    doubling the followed steps ends after a few rounds.
    """
    kept = written(words.select("word", "n"), "words")
    pairs = near_pairs(kept)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("word")))
    near = written(both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("a_n").alias("a_n")), "near-words")
    close = -F.col("best.rank") >= times * F.col("a_n")
    formed = near.select(
        F.col("a").alias("word"), "n_near", F.when(close, F.col("best.word")).alias("form"), F.when(close, -F.col("best.rank")).alias("form_n"),
    )
    steps = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return kept.join(formed, "word", "left").join(steps, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"),
    )
