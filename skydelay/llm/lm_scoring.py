"""Language-model scoring with a Brown class bigram model.

* Counts: every word of the training documents is counted (map-side first), whatever its frequency.
* Classes: the ``UNIT_WORDS`` most frequent words and ``SHAPES`` groups of all other words (by a hash of their last
  three bytes) are the units. All bigrams of units are counted over all training documents; this matrix has a size fixed
  by the two parameters, and exchange clustering moves its units between ``CLASSES`` classes, each to the class that
  raises the likelihood of the class bigrams most, until few still move. That is where every other word starts. The
  training texts are kept as word numbers, so a round is a pass over numbers: each task adds up by class what follows and
  precedes each word, one row per word and task is shuffled, and every frequent word outside the units moves to the class
  of the largest gain in the same likelihood: first all at once, then half of them in turn, for at most ``WIDE_PASSES``
  rounds or until few move. Then all words beyond the ``HEAD`` most frequent do the same, once. A round that lowers the
  likelihood is undone. Words that no training document holds take the class that most words seen once have in their
  shape group.
* Model: log10 P(text) sums, over words and the end, the class transition (Dirichlet-smoothed with the class
  frequencies) and the word's emission from its class. Emissions are discounted by d = n1 / (n1 + 2 n2), and what is
  taken off the words of a class is the probability of meeting an unseen word of that class, so each context's
  probabilities over known words and unseen-word events add up to 1 (the same event space as the base score's).
* Scoring: the ``HEAD`` most frequent words go to every task (a bounded table) and are looked up there; what is left of a
  document, its rarer words and the transitions next to them, is joined with the whole table of words by word and summed
  per document.

Nulls are empty texts (their one token is the end). Repeated rows count and are scored each on its own; null ids fold
like the empty text. Without training documents both scores are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_bytes, batches_of, fold, offsets_of, segment_sums
from skydelay.session import cut_lineage

UNIT_WORDS, SHAPES, CLASSES = 1024, 512, 64
HEAD = 1 << 18          # most frequent words whose counts go to every task
PRIOR = 10.0            # weight of the class frequencies in a transition
PASSES = 8              # of the exchange of the units
WIDE_PASSES = 3         # of the exchange of all other words
SHAPE_IDS = HEAD + 1    # word numbers of the shape groups
PAIRS = 4_000_000       # neighbours that a task holds before it counts them
KNOWN_WORDS = 500_000   # distinct words a Python worker remembers
END = b"\n"             # never a word
END_UNIT = UNIT_WORDS + SHAPES
UNITS = END_UNIT + 1


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased (on bytes ``lower`` does just that, ``split`` cuts at the six ASCII spaces)."""
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over the ``text`` column, one END per document."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches_of(batches, 512):
            for text in as_bytes(batch.column(0)):
                seen.update(tokens(text))
            seen[END] += batch.num_rows
            if len(seen) > KNOWN_WORDS:
                yield flush()
                seen.clear()
        yield flush()

    return texts.select("text").mapInArrow(count, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class _Units(dict):
    """Unit of a word; words outside the table fall into a shape group."""

    def __init__(self, head: list[bytes]) -> None:
        super().__init__({w: i for i, w in enumerate(head[:UNIT_WORDS])})
        self[END] = END_UNIT

    def __missing__(self, word: bytes) -> int:
        return UNIT_WORDS + crc32(word[-3:]) % SHAPES


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of every unit by exchange clustering of a unit bigram matrix; the last unit (END) keeps class 0 to itself."""
    n = len(bigrams)
    counts = bigrams.sum(0)
    assigned = np.zeros(n, dtype=np.int64)
    order = np.argsort(-counts[:-1], kind="stable")
    assigned[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), assigned] = 1
    after, before = bigrams @ member, bigrams.T @ member     # unit -> class counts of what follows and precedes
    joint = member.T @ after
    size = np.bincount(assigned, counts, classes)
    for _ in range(passes):
        moved = 0
        for w in order:
            if not counts[w]:
                continue
            old, own = assigned[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= own
            left[old] -= own
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= own
            size[old] -= counts[w]
            now = _xlogx(joint)
            diagonal = np.arange(classes)
            rows = _xlogx(joint + right) - now
            columns = _xlogx(joint + left[:, None]) - now
            corner = joint[diagonal, diagonal] + right + left + own
            gain = rows.sum(1) - rows[diagonal, diagonal] + columns.sum(0) - columns[diagonal, diagonal] \
                + _xlogx(corner) - now[diagonal, diagonal] - 2 * (_xlogx(size + counts[w]) - _xlogx(size))
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += own
            size[new] += counts[w]
            if new != old:
                moved += 1
                assigned[w] = new
                for table, column in ((after, bigrams[:, w]), (before, bigrams[w])):
                    table[:, old] -= column
                    table[:, new] += column
        if moved < 0.005 * n:
            break
    return assigned


class _Ids(dict):
    """Number of a word: its rank among the most frequent words, HEAD for END; all others by shape group, remembered."""

    def __init__(self, head: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(head))
        self[END] = HEAD

    def __missing__(self, word: bytes) -> int:
        number = self[word] = SHAPE_IDS + crc32(word[-3:]) % SHAPES
        return number


def rare_id(word: Column) -> Column:
    return F.xxhash64(word)


def numbered(texts: DataFrame, head: list[bytes]) -> DataFrame:
    """The texts as word numbers, END before and after each: rows (low, high, rare) hold runs of documents, the lower 16
    and the upper 8 bits of each number and the 64-bit hash (``rare_id``) of each word outside the head, as bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(head)  # HEAD words at most

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = _Ids(shared.value), {}
        for batch in batches_of(batches, 512):
            flat = [END]
            for text in as_bytes(batch.column(0)):
                flat += tokens(text)
                flat.append(END)
            at = np.fromiter(map(ids.__getitem__, flat), np.uint32, len(flat))
            outside = [flat[i] for i in np.flatnonzero(at >= SHAPE_IDS)]
            hashes.update((w, xxhash.xxh64_intdigest(w, 42)) for w in set(outside).difference(hashes))
            rare = np.fromiter(map(hashes.__getitem__, outside), np.uint64, len(outside))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in
                                              (at.astype("<u2"), (at >> 16).astype(np.uint8), rare.astype("<u8"))],
                                             ["low", "high", "rare"])
            if len(hashes) > KNOWN_WORDS:
                ids, hashes = _Ids(shared.value), {}

    return texts.select("text").mapInArrow(number, "low binary, high binary, rare binary")


def _runs(batches: Iterator[pa.RecordBatch], rare: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of a row of ``numbered``, and on request the hashes of its words outside the head in their places."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(row[0], "<u2") + (np.frombuffer(row[1], np.uint8).astype(np.int64) << 16)
            words = at
            if rare:
                words = at.copy()
                words[at >= SHAPE_IDS] = np.frombuffer(row[2], "<i8")
            yield at, words


def pair_counts(runs: DataFrame, kinds: np.ndarray, n_kinds: int, frequent: bool = False) -> np.ndarray:
    """How often a kind follows a kind, over all neighbouring words (of the head only); ``kinds`` by word number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(n_kinds ** 2, dtype=np.int64), [], 0

        def add() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=len(total))
                held.clear()

        for at, _ in _runs(batches):
            kind = kinds[at]
            codes = kind[:-1] * n_kinds + kind[1:]
            held.append(codes[(at[:-1] < SHAPE_IDS) & (at[1:] < SHAPE_IDS)] if frequent else codes)
            size += len(at)
            if size > len(total):
                add()
                size = 0
        add()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    found = runs.select("low", "high").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_kinds ** 2)  # n_kinds^2 rows at most
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n_kinds, n_kinds)


# cells of a word: counts by class of what follows, of what precedes (in two parts), itself as neighbour, its class
AFTER, BEFORE, BEFORE_UNIT, OWN, CLASS = 0, CLASSES, 2 * CLASSES, 3 * CLASSES, 3 * CLASSES + 1
CELLS = CLASS + 1
RARE_SIDE = 2 * CLASSES  # in ``contexts``: what is added to a cell if the neighbour is outside the head


def contexts(runs: DataFrame, classes: np.ndarray, rare: bool, half: int | None = None) -> DataFrame:
    """(word, class, own, cells, counts): what each task sees next to the words of the head but for the units (with
    ``half`` those of odd or even numbers only), or next to those outside it, by class. ``classes`` by word number."""
    small = classes.astype(np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            word, kind, cell, same = (np.concatenate(x) for x in zip(*held))
            names, number = np.unique(word, return_inverse=True) if rare else (np.arange(HEAD), word)
            first = np.zeros(len(names), dtype=np.int32)
            first[number] = kind
            own = np.bincount(number[same], minlength=len(names))
            keys, n = np.unique(number << 8 | cell, return_counts=True)
            per_word = np.bincount(keys >> 8, minlength=len(names))
            some = np.flatnonzero(per_word)
            words, first, own, starts = names[some], first[some], own[some], offsets_of(per_word[some])
            cells, counts = (keys & 255).astype(np.uint8).tobytes(), n.astype("<u4").tobytes()
            for at in range(0, len(words), 20_000):
                some = slice(at, at + 20_000)
                cut = starts[at:at + 20_001]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[some]), pa.array(first[some]), pa.array(own[some]),
                     pa.array([cells[i:j] for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                     pa.array([counts[4 * i:4 * j] for i, j in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["word", "class", "own", "cells", "counts"])

        for at, words in _runs(batches, rare):
            kind = small[at]
            outside = at >= SHAPE_IDS
            wanted = outside if rare else (at >= UNIT_WORDS) & (at < HEAD)
            if half is not None:
                wanted &= at % 2 == half
            cell = kind + outside * np.uint8(RARE_SIDE)
            same = (words[:-1] == words[1:]) & wanted[1:]
            after, before = np.flatnonzero(wanted[:-1]), np.flatnonzero(wanted[1:])
            held.append((words[:-1][after], kind[:-1][after], cell[1:][after], same[after]))
            held.append((words[1:][before], kind[1:][before], cell[:-1][before] + np.uint8(BEFORE), np.zeros(len(before), dtype=bool)))
            size += len(after) + len(before)
            if size > PAIRS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    columns = ["low", "high", "rare"] if rare else ["low", "high"]
    return runs.select(*columns).mapInArrow(count, "word long, class int, own long, cells binary, counts binary")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and their lengths."""
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]].copy(), np.diff(at)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of ``contexts`` sorted by word, each word's together: words, their class, how often each follows itself, and
    in three arrays (place among these words, cell, count)."""
    kept = None
    for batch in chain(batches_of(batches, 4000), [None]):
        if batch is None:
            if kept is not None:
                yield kept
            return
        if not batch.num_rows:
            continue
        word, kind, own = (batch.column(k).to_numpy() for k in range(3))
        (cell, n), (times, _) = _joined(batch.column(3)), _joined(batch.column(4))
        times = times.view("<u4").astype(float)
        if kept is not None:  # the last word so far, which may go on
            word, kind, own = (np.concatenate([x, y]) for x, y in zip(kept[:3], (word, kind, own)))
            cell, times, n = np.concatenate([kept[4], cell]), np.concatenate([kept[5], times]), np.concatenate([[len(kept[4])], n])
        words, row = np.unique(word, return_inverse=True)
        kinds = np.zeros(len(words), dtype=np.int64)
        kinds[row] = kind  # words of equal number share what they have
        owns, place = np.bincount(row, own, len(words)), np.repeat(row, n)
        end = np.searchsorted(place, len(words) - 1)  # rows are sorted by word
        yield words[:-1], kinds[:-1], owns[:-1], place[:end], cell[:end], times[:end]
        last = np.bincount(cell[end:], times[end:])
        seen = np.flatnonzero(last)
        kept = words[-1:], kinds[-1:], owns[-1:], np.zeros(len(seen), dtype=np.int64), seen.astype(np.uint8), last[seen]


def gains(cells: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What the likelihood gains by each class for each word (a row of cells), the word taken out of its own class first:
    the gain of ``exchange``, summed over the classes that the word has been seen next to."""
    return _gains(cells[:, AFTER:BEFORE].copy(), cells[:, BEFORE:BEFORE_UNIT] + cells[:, BEFORE_UNIT:OWN], cells[:, OWN],
                  cells[:, CLASS].astype(np.int64), joint)


def _gains(right: np.ndarray, left: np.ndarray, own: np.ndarray, old: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """``gains`` by counts of what follows and of what precedes (both are changed)."""
    f, size, diagonal, rows = _xlogx, joint.sum(0), joint.diagonal(), np.arange(len(old))
    n = left.sum(1)
    right[rows, old] -= own
    left[rows, old] -= own

    def more(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return f(x + by) - f(x)

    def summed(part: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sum over the classes j of ``part`` of what adding part[j] to table[:, j] gives."""
        owner, j = np.nonzero(part)
        kinds, which = np.unique(part[owner, j].astype(np.int64) * CLASSES + j, return_inverse=True)
        each = more(table[:, kinds % CLASSES].T, (kinds // CLASSES)[:, None])
        out, seen = np.zeros((len(part), CLASSES)), np.bincount(owner, minlength=len(part))
        starts = offsets_of(seen)
        for k in range(seen.max(initial=0)):  # the k-th class of every word that has so many
            some = np.flatnonzero(seen > k)
            out[some] += each[which[starts[some] + k]]
        return out

    times, which = np.unique(n, return_inverse=True)
    out = summed(right, joint) + summed(left, joint.T) - 2 * more(size, times[:, None])[which]
    # all else is 0 but for classes that the word has been seen next to: the cells shared by both sides, and those shared
    # with the old class, which have lost what the word had there
    w, j = np.nonzero((right != 0) | (left != 0) | (own != 0)[:, None])
    k, r, l, table = old[w], right[w, j], left[w, j], f(joint)
    d, to_old, from_old, right_old, left_old = diagonal[j], joint[j, k], joint[k, j], right[w, k], left[w, k]
    f_to, f_from, less_to, less_from = table[j, k], table[k, j], f(to_old - l), f(from_old - r)
    out[w, j] += f(d + r + l + own[w]) - f(d + r) - f(d + l) + f(d) \
        + f(to_old - l + right_old) - less_to - f(to_old + right_old) + f_to \
        + f(from_old - r + left_old) - less_from - f(from_old + left_old) + f_from
    lost = np.where(j == k, 0, f_from - less_from + f_to - less_to)
    both = right[rows, old] + left[rows, old] + own
    out[rows, old] = np.bincount(w, lost, len(old)) + f(diagonal[old]) - f(diagonal[old] - both) \
        - 2 * (f(size[old]) - f(size[old] - n))
    out[:, 0] = -np.inf
    return out


def moved(found: DataFrame, joint: np.ndarray) -> DataFrame:
    """(id, class, moves) of every word of ``contexts``: the class of the largest gain; and
    with a null id (code, n), summed: class bigrams of these words under their new classes next to words of the head."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 2)
        names = ["id", "class", "moves", "code", "n"]
        for words, old, own, place, cell, times in _merged(batches):
            if not len(words):
                continue
            kind, before = (cell % CLASSES).astype(np.int64), cell // CLASSES % 2 == 1
            right, left = (np.bincount(place[side] * CLASSES + kind[side], times[side], len(words) * CLASSES).reshape(-1, CLASSES)
                           for side in (~before, before))
            gain = _gains(right, left, own, old, joint)
            new = gain.argmax(1)
            stays = gain[np.arange(len(new)), new] <= gain[np.arange(len(new)), old] + 1e-9
            new = np.where(stays, old, new)
            head, mine = cell < RARE_SIDE, new[place]
            code = np.where(before, kind * CLASSES + mine, mine * CLASSES + kind)
            total += np.bincount(code[head], times[head], CLASSES ** 2)
            nothing = pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(new.astype(np.int32)), pa.array(new != old), *nothing], names)
        seen = np.flatnonzero(total)
        blank = [pa.nulls(len(seen), k) for k in (pa.int64(), pa.int32(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(seen.astype(np.int32)), pa.array(total[seen].astype(np.int64))], names)

    return found.repartition("word").sortWithinPartitions("word") \
        .mapInArrow(choose, "id long, class int, moves boolean, code int, n long")


def _likelihood(joint: np.ndarray) -> float:
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


def exchange_wide(runs: DataFrame, classes: np.ndarray, passes: int = WIDE_PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes by word number and class bigrams after the exchange of the words of the head outside the units; all other
    words stay in the classes of their shape groups."""
    best = None
    for k in range(passes + 1):
        joint = pair_counts(runs, classes, CLASSES)
        if best is not None and _likelihood(joint) <= _likelihood(best[1]):
            break
        best = classes, joint
        if k == passes:
            break
        half = k % 2 if k else None
        new = moved(contexts(runs, classes, rare=False, half=half), joint).where("id is not null") \
            .select("id", "class", "moves").toArrow()  # HEAD rows at most
        moves = int(new["moves"].to_numpy().sum())
        if moves < max(1, 0.005 * len(new) * (1 if half is None else 2)):
            break
        classes = classes.copy()
        classes[new["id"].to_numpy()] = new["class"].to_numpy()
    return best


def place_rare(runs: DataFrame, classes: np.ndarray, joint: np.ndarray) -> tuple[DataFrame | None, np.ndarray]:
    """(id, class) of every word outside the head, each moved to the class of the largest gain, and the class bigrams
    under these classes; no table where no word moves or the likelihood falls."""
    new = cut_lineage(moved(contexts(runs, classes, rare=True), joint))
    if not new.where("moves").take(1):
        return None, joint
    placed = new.where("id is not null").select("id", "class")
    both = rare_pairs(runs)
    for side in "ab":
        both = both.join(placed.select(F.col("id").alias(side), F.col("class").alias(f"of_{side}")).hint("shuffle_hash"), side)
    both = both.select((F.col("of_a") * CLASSES + F.col("of_b")).alias("code"), "n")
    out = pair_counts(runs, classes, CLASSES, frequent=True).ravel()
    for code, n in new.where("id is null").select("code", "n").unionByName(both).groupBy("code").agg(F.sum("n")).collect():
        out[code] += n  # CLASSES^2 rows at most
    out = out.reshape(CLASSES, CLASSES)
    return (placed, out) if _likelihood(out) > _likelihood(joint) else (None, joint)


def rare_pairs(runs: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring words that are both outside the head, by hash; counted in each run of documents only."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, words in _runs(batches, rare=True):
            both = np.flatnonzero((at[:-1] >= SHAPE_IDS) & (at[1:] >= SHAPE_IDS))
            pairs, n = np.unique(np.column_stack([words[both], words[both + 1]]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["a", "b", "n"])

    return runs.select("low", "high", "rare").mapInArrow(count, "a long, b long, n long")


class ClassModel:
    """Transition and emission tables, and the counts of the most frequent words."""

    def __init__(self, head: list[tuple[bytes, int]], bigrams: np.ndarray, discount: float) -> None:
        self.class_of_unit = exchange(bigrams)
        member = np.zeros((UNITS, CLASSES))
        member[np.arange(UNITS), self.class_of_unit] = 1
        self.discount = discount
        self.head = head
        self.units = _Units([w for w, _ in head if w != END])
        self.head_class = np.array([self.class_of(w) for w, _ in head], dtype=np.int64)
        self.settle(member.T @ bigrams @ member)

    def settle(self, joint: np.ndarray) -> None:
        """Takes the sizes and transitions from the class bigrams."""
        self.size = joint.sum(0)
        frequency = (self.size + 1) / (self.size.sum() + CLASSES)
        self.transition = np.log10((joint + PRIOR * frequency) / (joint.sum(1, keepdims=True) + PRIOR))

    def class_of(self, word: bytes) -> int:
        """Of a unit or of a word not seen in training (all words start from it)."""
        return int(self.class_of_unit[self.units[word]])


class _Vocabulary(dict):
    """Number of a word: the frequent ones first, then new ones as they come. Arrays by number: class (of a rarer word:
    the one it has if no training document holds it), base part and score part; they have room for words to come."""

    def __init__(self, model: ClassModel) -> None:
        super().__init__((w, i) for i, (w, _) in enumerate(model.head))
        self.model, self.first = model, len(model.head)
        self.new: list[bytes] = []
        classes = model.head_class
        counts = np.array([n for _, n in model.head], dtype=np.float64)
        log_size = np.log10(np.maximum(model.size, 1))
        score = np.log10(np.maximum(counts - model.discount, 1e-9)) - log_size[classes] if len(classes) else np.zeros(0)
        if END in self:
            score[self[END]] = 0.0  # alone in its class
        self.tables, self.filled = [classes, np.log10(counts + 1), score], self.first

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.first + len(self.new)
        self.new.append(word)
        return number

    def grown(self) -> list[np.ndarray]:
        """The arrays, filled up to the words numbered so far."""
        fresh, end = self.new[self.filled - self.first:], self.first + len(self.new)
        if end > len(self.tables[0]):
            room = end // 2
            self.tables = [np.concatenate([t, np.zeros(end + room - len(t), dtype=t.dtype)]) for t in self.tables]
        if fresh:
            units = np.fromiter(map(self.model.units.__getitem__, fresh), np.int64, len(fresh))
            self.tables[0][self.filled:end] = self.model.class_of_unit[units]
            self.filled = end
        return self.tables


def _partial_scores(docs: DataFrame, shared: Broadcast[ClassModel]) -> DataFrame:
    """Per row what needs no rarer word; its rarer words: (word, class, place, times), numbered by place; and the
    transitions next to them, first << 32 | second, each a class or CLASSES + place."""
    kinds = ("doc_id long, n_tokens long, n_known long, base double, score double, "
             "rare array<struct<word: binary, class: int, place: int, times: long>>, steps array<long>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(shared.value)
        for batch in batches_of(batches, 512):
            if len(vocabulary.new) > KNOWN_WORDS:
                vocabulary = _Vocabulary(shared.value)
            words = [tokens(t) + [END] for t in as_bytes(batch.column(1))]
            offsets = offsets_of([len(w) for w in words])
            numbers = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(words)), np.int64, int(offsets[-1]))
            classes, base, emission = (t[numbers] for t in vocabulary.grown())
            owner = np.repeat(np.arange(len(words)), np.diff(offsets))
            # rarer words, once per document
            rare = numbers >= vocabulary.first
            keys, inverse, times = np.unique(owner[rare] << 32 | numbers[rare], return_inverse=True, return_counts=True)
            own, word = keys >> 32, keys & 0xFFFFFFFF
            starts = offsets_of(np.bincount(own, minlength=len(words)))
            place = np.arange(len(keys)) - starts[own]
            codes = classes.copy()
            codes[rare] = CLASSES + place[inverse]
            previous = np.concatenate([[0], codes[:-1]])
            previous[offsets[:-1]] = 0  # a document follows an END, whose class is 0
            later = (codes >= CLASSES) | (previous >= CLASSES)
            step = np.where(later, 0.0, vocabulary.model.transition[np.where(later, 0, previous), np.where(later, 0, codes)])
            n_tokens = np.diff(offsets)
            n_known = n_tokens - np.bincount(owner[rare], minlength=len(words))
            base, total = segment_sums(base, offsets), segment_sums(emission + step, offsets)
            structs = pa.StructArray.from_arrays(
                [pa.array([vocabulary.new[i - vocabulary.first] for i in word.tolist()], pa.binary()),
                 pa.array(vocabulary.tables[0][word].astype(np.int32)), pa.array(place.astype(np.int32)),
                 pa.array(times.astype(np.int64))], ["word", "class", "place", "times"])
            steps = pa.ListArray.from_arrays(
                pa.array(offsets_of(np.bincount(owner[later], minlength=len(words))).astype(np.int32)),
                pa.array(previous[later] << 32 | codes[later]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), structs), steps],
                ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "steps"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, kinds)


def _late_transitions(steps: Column, classes: Column, transition: np.ndarray) -> Column:
    """Sum of the transitions of ``steps``, given place * CLASSES + class of the row's rarer words in order."""
    @F.arrow_udf(T.DoubleType())
    def total(steps: pa.Array, classes: pa.Array) -> pa.Array:
        n = steps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = offsets_of(classes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1]
        codes = steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.concatenate([classes.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % CLASSES, [0]])
        first = np.repeat(starts, n)

        def class_of(code: np.ndarray) -> np.ndarray:
            return np.where(code < CLASSES, code, known[np.where(code < CLASSES, -1, first + code - CLASSES)])

        return pa.array(segment_sums(transition[class_of(codes >> 32), class_of(codes & 0xFFFFFFFF)], offsets_of(n)))
    return total(steps, classes)


def _learn(train: DataFrame, counts: DataFrame, head: list[tuple[bytes, int]], discount: float) -> tuple[ClassModel, DataFrame]:
    """The model, and the rarer words of the training documents (word, n, class)."""
    words = [w for w, _ in head if w != END]
    runs = cut_lineage(numbered(train, words))
    spot = {w: i for i, w in enumerate(words)}
    spot[END] = HEAD
    place = np.array([spot[w] for w, _ in head], dtype=np.int64)
    of_shape = _Units(words)
    units = np.arange(SHAPE_IDS + SHAPES)
    units[:len(words)] = [of_shape[w] for w in words]
    units[HEAD], units[SHAPE_IDS:] = END_UNIT, UNIT_WORDS + np.arange(SHAPES)
    units[len(words):HEAD] = 0  # numbers without a word
    model = ClassModel(head, pair_counts(runs, units, UNITS), discount)
    shared = train.sparkSession.sparkContext.broadcast((model.units, model.class_of_unit))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, class_of = shared.value
        for batch in batches:
            first = class_of[np.array([unit[w] for w in as_bytes(batch.column(0))], dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int32))], ["word", "n", "class"])

    last = head[-1] if head else (b"", 0)
    others = (F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > F.lit(last[0])))
    rarer = counts.where(others & (F.col("word") != F.lit(END))).select("word", "n")
    placed = None
    if head:
        classes, joint = exchange_wide(runs, model.class_of_unit[units])
        placed, joint = place_rare(runs, classes, joint)
        model.head_class = classes[place]
        model.settle(joint)
    if placed is None:
        rarer = rarer.mapInArrow(start, "word binary, n long, class int")
    else:
        rarer = rarer.withColumn("id", rare_id(F.col("word"))).join(placed.hint("shuffle_hash"), "id").select("word", "n", "class")
    rarer = cut_lineage(rarer)
    if head:
        _place_unseen(model, rarer)
    return model, rarer


def _place_unseen(model: ClassModel, rarer: DataFrame) -> None:
    """Gives every shape group the class that most of its words seen once have (ties: the lowest)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHAPES * CLASSES, dtype=np.int64)
        for batch in batches:
            shapes = np.array([crc32(w[-3:]) % SHAPES for w in as_bytes(batch.column(0))], dtype=np.int64)
            total += np.bincount(shapes * CLASSES + batch.column(1).to_numpy(), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    once = np.zeros(SHAPES * CLASSES)
    for code, n in rarer.where("n = 1").select("word", "class").mapInArrow(count, "code int, n long") \
            .groupBy("code").agg(F.sum("n")).collect():  # SHAPES * CLASSES rows at most
        once[code] = n
    for (w, n), c in zip(model.head, model.head_class):
        if n == 1 and w != END:
            once[crc32(w[-3:]) % SHAPES * CLASSES + c] += 1
    once = once.reshape(SHAPES, CLASSES)
    some = np.flatnonzero(once.sum(1))
    model.class_of_unit[UNIT_WORDS + some] = once[some].argmax(1)


def score(docs: DataFrame, head_words: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    held = fold(F.col("doc_id"), 7) == 2
    train = docs.where(~held)
    counts = cut_lineage(word_counts(train))
    is_word = F.col("word") != F.lit(END)
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"),
                     F.sum((is_word & (F.col("n") == 1)).cast("long")).alias("once"),
                     F.sum((is_word & (F.col("n") == 2)).cast("long")).alias("twice"),
                     *[F.count_if(F.col("n") >= F.lit(2 ** k)).alias(f"from{k}") for k in range(62)]).first()
    total, distinct = row["n"] or 0, row["v"]
    discount = row["once"] / (row["once"] + 2 * row["twice"]) if row["once"] else 0.5
    # the top list is cut from words of at least the largest power of two of occurrences that HEAD words reach; Arrow
    # tables, as rows of Python objects would take the driver a hundred times the memory
    least = max((2 ** k for k in range(62) if (row[f"from{k}"] or 0) >= head_words), default=1)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(head_words).toArrow()  # HEAD rows at most
    head = list(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    model, rarer = _learn(train, counts, head, min(discount, 0.99))
    del top
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words and CLASSES^2 numbers

    kinds = np.bincount(model.head_class[[w != END for w, _ in head]], minlength=CLASSES).astype(np.float64)
    for c, k in rarer.groupBy("class").count().collect():  # CLASSES rows
        kinds[c] += k
    log_size = np.log10(np.maximum(model.size, 1))
    unseen = np.where(kinds > 0, np.log10(np.maximum(model.discount * kinds, 1e-300)), 0.0)

    def by_class(values: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("class"))

    partial = cut_lineage(_partial_scores(docs, shared).withColumn("row_no", F.monotonically_increasing_id()))
    rare = partial.select("row_no", F.inline("rare")).withColumnRenamed("class", "if_unseen").join(rarer.hint("shuffle_hash"), "word", "left") \
        .withColumn("class", F.coalesce("class", "if_unseen"))
    some = F.col("n").isNotNull()
    sums = rare.groupBy("row_no").agg(
        F.sum(F.when(some, F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(F.when(some, F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("base_rare"),
        F.sum(F.col("times") * (F.when(some, F.log10(F.col("n") - F.lit(model.discount))).otherwise(by_class(unseen))
                                - by_class(log_size))).alias("score_rare"),
        F.sort_array(F.collect_list(F.col("place").cast("long") * CLASSES + F.col("class"))).alias("classes"))  # the row's own words
    per_token = float(np.log10(total + distinct + 1))
    out = partial.drop("rare").join(sums, "row_no", "left") \
        .withColumn("late", _late_transitions(F.col("steps"), F.col("classes"), model.transition))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + F.coalesce("score_rare", F.lit(0.0)) + F.col("late")).alias("score") if total else F.lit(0.0).alias("score"))


def op4(docs: DataFrame) -> DataFrame:
    return score(docs)
