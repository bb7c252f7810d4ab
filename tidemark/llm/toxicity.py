"""Toxicity of texts after noisy-channel restoration of disguised words."""

from __future__ import annotations

import itertools
import math
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows of each class that the classifier is fitted on, at most about so many.
MOST_LABELLED = 6000

# Symbols of the character model: a word's edge, letters, digits, any other letter, anything else.
_SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0123456789àâäáçèéêëíîïñóôöùûüúßœ"
_OTHER_LETTER, _OTHER = len(_SYMBOLS), len(_SYMBOLS) + 1
_WIDTH = len(_SYMBOLS) + 2
_NUMBER = {c: i for i, c in enumerate(_SYMBOLS)}

# What a character may stand for besides itself.
_LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c",
}
_GAPS = ".-_*~'·"
_FRONT, _BACK = "\"'([{<*#&%.,;:-_~", "\"')]}>*#&%.,;:!?$@-_~|+"
_REPEAT = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1*", re.DOTALL)
# Punctuation around a word that no look-alike is among.
_PLAIN_FRONT, _PLAIN_BACK = ("".join(c for c in x if c not in _LEET) for x in (_FRONT, _BACK))
#: Words with at most so many paths are decoded together, by scoring all of them.
_MOST_PATHS = 16
_DISGUISE = re.compile("[" + re.escape("".join(_LEET) + _GAPS) + "]")
_LETTER = re.compile(r"[^\W\d_]")
#: Natural logarithms of how likely a writer is to disguise a character in each way.
_SWAP, _STRETCH, _GAP = -1.0, -0.7, -0.7


def _symbol(c: str) -> int:
    n = _NUMBER.get(c)
    return n if n is not None else (_OTHER_LETTER if c.isalpha() else _OTHER)


def core(word: str) -> str:
    """The folded word without quotes, brackets and punctuation around it."""
    return word.lower().lstrip(_FRONT).rstrip(_BACK)


def shell(word: str) -> str:
    """The folded word without punctuation around it, but with look-alikes at its ends."""
    return word.lower().lstrip(_PLAIN_FRONT).rstrip(_PLAIN_BACK)


def disguised(word: str) -> bool:
    """Whether the lattice of ``word`` has more than one path: doubled characters, look-alikes
    (also at the ends, where they may be punctuation as well) or gaps."""
    return bool((_DISGUISE.search(word) or _REPEAT.search(word)) and _LETTER.search(word))


def lattice(word: str, ends: bool = False) -> list[list[tuple[str, float]]]:
    """What each run of equal characters in ``word`` may stand for, with its price.

    Runs of a character may have been stretched from one or two, look-alikes may stand for
    letters, and marks between letters may have been put in. Look-alikes that are punctuation
    around the word otherwise may be either, or letters only with ``ends``.
    """
    lead, trail = len(word) - len(word.lstrip(_FRONT)), len(word.rstrip(_BACK))
    if lead >= trail:
        lead, trail = 0, len(word)
    found = []
    for run in _RUN.finditer(word):
        c, n, at, end = run[1], len(run[0]), run.start(), run.end()
        swaps = []
        for x in _LEET.get(c, ""):
            swaps += [(x * min(n, 2), _SWAP), (x, _SWAP + _STRETCH)][: 1 + (n > 1)]
        if at < lead or at >= trail:
            found.append(swaps if ends and swaps else [("", 0.0), *swaps])
            continue
        choices = [(c * min(n, 2), _STRETCH if n > 2 else 0.0)]
        if n > 1:
            choices.append((c, _STRETCH))
        choices += swaps
        if c in _GAPS and lead < at and end < trail:
            choices.append(("", _GAP))
        if n > 2 and not c.isalpha() and c not in _LEET:
            choices = [(c * n, 0.0), *choices[1:]]
        found.append(choices)
    return found


@dataclass(frozen=True)
class CharacterModel:
    """Interpolated trigram log-probabilities of characters, a cube of |alphabet|³ floats."""

    logs: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(_WIDTH, _WIDTH, _WIDTH).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
        mix = 0.7 * share(three) + 0.2 * share(two)[None] + 0.0999 * share(one)[None, None] + 0.0001 / _WIDTH
        return CharacterModel(np.log(mix).astype(np.float32))

    def restore(self, word: str, ends: bool = False) -> str:
        """The likeliest plain word behind ``word``: Viterbi over its lattice.

        A state is the last two characters; each run keeps the best path to each state.
        """
        logs = self.logs
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for choices in lattice(word, ends):
            better: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in paths.items():
                for text, price in choices:
                    x, y, total = a, b, cost + price
                    for s in map(_symbol, text[:2]):
                        total += logs[x, y, s]
                        x, y = y, s
                    if (x, y) not in better or better[x, y][0] < total:
                        better[x, y] = (total, (path, text))
            paths = better
        cost, path = max(((t + logs[a, b, 0], p) for (a, b), (t, p) in paths.items()), key=lambda x: x[0])
        found = []
        while path:
            path, text = path
            found.append(text)
        return "".join(reversed(found))

    def restore_all(self, asked: list[tuple[str, bool]]) -> list[str]:
        """``restore`` of many words: where paths are few, all are scored in one go."""
        found, places, first, texts, prices = [""] * len(asked), [], [], [], []
        for i, (word, ends) in enumerate(asked):
            choices = lattice(word, ends)
            if math.prod(map(len, choices)) > _MOST_PATHS or any(len(x) > 2 for c in choices for x, _ in c):
                found[i] = self.restore(word, ends)
                continue
            places.append(i)
            first.append(len(texts))
            for path in itertools.product(*choices):
                texts.append("".join([x for x, _ in path]))
                prices.append(sum([p for _, p in path]))
        if texts:
            joint = np.frombuffer("^^".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            distinct, which = np.unique(joint, return_inverse=True)
            coded = np.array([_symbol(chr(c)) for c in distinct], np.int64)[which]
            # Text i begins after i + 1 pairs of edges; its trigrams end on its characters and an edge.
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
            begins = np.cumsum(lengths) - lengths
            logs = self.logs[coded[:-2], coded[1:-1], coded[2:]].astype(float)[: int(lengths.sum())]
            skip = begins + lengths - 1  # from the end of a text over its pair of edges
            logs[skip] = 0
            score = np.add.reduceat(logs, begins) + prices
            for i, a, b in zip(places, first, [*first[1:], len(texts)]):
                found[i] = texts[a + int(np.argmax(score[a:b]))]
        return found

    def spell(self, letters: str) -> list[str]:
        """The likeliest words behind ``letters`` that were written with blanks between them.

        At each blank a word may end or nothing be. A letter may be a look-alike, a mark a gap,
        and one that repeats the letter before may have been stretched. Words end as in the
        character model, so a state is the last two characters as in ``restore``.
        """
        logs = self.logs
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(letters):
            choices = [(c, 0.0), *((x, _SWAP) for x in _LEET.get(c, ""))]
            better: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(state: tuple[int, int], total: float, path: tuple) -> None:
                if state not in better or better[state][0] < total:
                    better[state] = (total, path)

            begin = (-math.inf, ())
            for (a, b), (cost, path) in paths.items():
                if i and c in _GAPS and i < len(letters) - 1:
                    offer((a, b), cost + _GAP, path)
                if i and c == letters[i - 1]:
                    offer((a, b), cost + _STRETCH, path)
                for x, price in choices:
                    n = _symbol(x)
                    offer((b, n), cost + price + logs[a, b, n], (path, x))
                if i:
                    begin = max(begin, (cost + logs[a, b, 0], (path, " ")), key=lambda x: x[0])
            if begin[1]:
                for x, price in choices:
                    n = _symbol(x)
                    offer((0, n), begin[0] + price + logs[0, 0, n], (begin[1], x))
            paths = better
        path = max(((t + logs[a, b, 0], p) for (a, b), (t, p) in paths.items()), key=lambda x: x[0])[1]
        found = []
        while path:
            path, x = path
            found.append(x)
        return "".join(reversed(found)).split()


def character_model(docs: DataFrame, text_col: str) -> CharacterModel:
    """Counts over all words of letters in all texts. |alphabet|³ sums reach the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WIDTH**3, np.int64)
        table = np.full(0x250, _OTHER, np.int64)
        for i in range(len(table)):
            table[i] = _symbol(chr(i))
        for batch in batches:
            for part in words.slices(batch, 0):
                codes, distinct, _ = words.split_words(part.column(0))
                times = np.bincount(codes, minlength=len(distinct))
                plain = [core(w) for w in distinct.to_pylist()]
                keep = np.fromiter((w.isalpha() for w in plain), bool, len(plain))
                plain, times = [w for w, k in zip(plain, keep) if k], times[keep]
                if not plain:
                    continue
                joint = np.frombuffer("^^".join(["", *plain, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
                coded = np.where(joint < len(table), table[np.minimum(joint, len(table) - 1)], _OTHER_LETTER)
                lengths = np.fromiter(map(len, plain), np.int64, len(plain))
                # Word i begins after i + 1 pairs of edges; its last trigram ends on an edge.
                weight = np.repeat(times, lengths + 2)
                key = (coded[:-2] * _WIDTH + coded[1:-1]) * _WIDTH + coded[2:]
                key = key[: len(weight)]
                good = ~((coded[1:-1][: len(weight)] == 0) & (coded[2:][: len(weight)] == 0))
                total += np.bincount(key[good], weights=weight[good], minlength=_WIDTH**3).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(words.tidied(count), "code long, n long")
    counts = np.zeros(_WIDTH**3)
    for row in parts.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["code"]] = row["n"]
    return CharacterModel.of(counts)


def restored_words(texts: pa.Array, model: CharacterModel, known: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes, distinct restored words and offsets of the texts, spelled-out words joined.

    A run of three or more one-character words has words written with spaces in it; it is
    followed by the codes of its likeliest words of two or more letters, and of all of it joined.
    A disguised word has the code of its restored word, and those of its other readings after
    it: as it is spelled, if that is letters only, and with the look-alikes at its ends as
    letters.
    """
    codes, distinct, offsets = words.split_words(texts)
    spelled = distinct.to_pylist()

    def learn(asked: list[str]) -> None:
        if len(known) > 50_000:
            known.clear()
        new = [w for w in dict.fromkeys(asked) if w not in known]
        ended = [w for w in new if core(w) != w and core(w)]
        got = model.restore_all([*((w, False) for w in new), *((w, True) for w in ended)])
        last = dict(zip(ended, got[len(new) :]))
        for w, best in zip(new, got):
            plain = core(w)
            others = [plain] if plain.isalpha() else []
            known[w] = tuple(dict.fromkeys([best, *others, *([last[w]] if w in last else [])]))

    shells = list(map(shell, spelled))
    hidden = [i for i, w in enumerate(shells) if disguised(w)]
    learn([shells[i] for i in hidden])
    found, more = list(map(core, spelled)), np.zeros(len(spelled), bool)
    for i in hidden:
        found[i] = known[shells[i]][0]
        more[i] = len(known[shells[i]]) > 1
    joined: list[tuple[int, int]] = []
    others: dict[int, range] = {}
    for y in np.flatnonzero(more[codes]):
        c = int(codes[y])
        if c not in others:
            others[c] = range(len(found), len(found) + len(known[shells[c]]) - 1)
            found += known[shells[c]][1:]
        joined += [(int(y) + 1, n) for n in others[c]]
    single = np.fromiter((len(w) == 1 for w in spelled), bool, len(spelled))
    lone = np.concatenate(([False], single[codes], [False]))
    begins, ends = np.flatnonzero(lone[1:] & ~lone[:-1]), np.flatnonzero(lone[:-1] & ~lone[1:])
    for a, b in zip(begins, ends):
        if b - a < 3:
            continue
        inner = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)]
        for x, y in zip([a, *inner], [*inner, b]):
            whole = "".join(spelled[c] for c in codes[x:y]).lower()
            if y - x >= 3 and _LETTER.search(whole):
                for w in dict.fromkeys([*(w for w in model.spell(whole) if len(w) > 1), model.restore(whole)]):
                    joined.append((y, len(found)))
                    found.append(w)
    if joined:
        # A word joined at a text's end stays in that text: places equal to an offset count.
        joined.sort(key=lambda x: x[0])
        places = np.array([y for y, _ in joined])
        codes = np.insert(codes.astype(np.int64), places, [c for _, c in joined])
        offsets = offsets + np.searchsorted(places, offsets, side="right")
    return codes, found, offsets


@dataclass(frozen=True)
class ToxicityModel:
    """Restoration and rules: ``rules`` has a probability for each beginning or whole word."""

    characters: CharacterModel
    rules: dict[str, float]
    base: float
    prefixes: tuple[int, ...] = (4, 5, 6)

    def of_word(self, word: str) -> float:
        rules = self.rules
        best = rules.get("=" + word, 0.0)
        for n in self.prefixes:
            if len(word) >= n:
                best = max(best, rules.get(word[:n], 0.0))
        return best

    def joint(self, chances: list[float]) -> float:
        """Rules of 0.5 or more add up; weaker ones only rank texts that have no other."""
        strong = [p for p in chances if p >= 0.5]
        if strong:
            return 1 - math.prod(1 - p for p in strong)
        return max([self.base, *chances])


def _features(words_col: str, prefixes: tuple[int, ...]) -> Column:
    """Whole words (marked with =) and beginnings of a row's distinct words."""
    def begin(n: int) -> Column:
        return F.transform(F.filter(words_col, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))

    whole = F.transform(words_col, lambda w: F.concat(F.lit("="), w))
    return F.array_distinct(F.concat(whole, *map(begin, prefixes)))


def _surely(n1: float, n0: float, w1: float, w0: float, z: float = 1.64) -> float:
    """Lower confidence bound of the share of toxic documents among those with a feature."""
    n = n1 + n0
    p = n1 * w1 / (n1 * w1 + n0 * w0)
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learns: Callable[[Column], Column] | None = None,
    most_labelled: int = MOST_LABELLED,
) -> ToxicityModel:
    """Character model of all texts, and rules from at most about ``most_labelled`` rows a class.

    The sample are the labelled rows with the smallest hashes of their id, of those for which
    ``learns`` holds. A rule is a beginning of a word or a whole word; its probability is the
    lower confidence bound of the share of toxic documents among those that have it. Rules are
    taken one by one, always that which covers most toxic documents not covered yet, so words
    that copies of one document bring along are not learned. Labels that are null or not 0 or
    1, and labels of missing documents, teach nothing; without labels there are no rules.
    """
    model = character_model(docs, text_col)
    prefixes = ToxicityModel.prefixes
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    if learns is not None:
        known = known.where(learns(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = (F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20))
    share = F.when(F.col("label") == 1, min(1.0, most_labelled / max(1, sizes.get(1, 0)))).otherwise(
        min(1.0, most_labelled / max(1, sizes.get(0, 0)))
    )
    sample = through_table(known.where(place <= share), "toxic-sample")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in words.slices(batch, 1):
                codes, found, offsets = restored_words(part.column(1), model, seen)
                rows = [sorted({found[c] for c in codes[a:b]}) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.string()))], ["label", "words"]
                )

    # The sample is bounded by its parameter, so it may be broadcast.
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), "id"
    )
    taught = taught.select("label", "text").mapInArrow(words.tidied(restore), "label int, words array<string>")
    taught = taught.select("label", _features("words", prefixes).alias("features"))
    taught = through_table(taught.withColumn("row", F.monotonically_increasing_id()), "toxic-taught")
    got = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    if not got.get(1):
        return ToxicityModel(model, {}, 0.0)
    weight = {k: sizes[k] / got[k] for k in got}
    counts = (
        taught.select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
        .where("n1 >= 2 AND n1 * 2 >= n0")
    )
    sure = {}
    for r in counts.toLocalIterator():
        p = _surely(r["n1"], r["n0"], weight[1], weight.get(0, 1.0))
        if p > 0.25:
            sure[r["feature"]] = p
    # Rules by coverage, on the toxic rows of the sample.
    has = defaultdict(set)
    if sure:
        spark = docs.sparkSession
        names = F.broadcast(spark.createDataFrame([(f,) for f in sure], "feature string"))
        toxic = taught.where("label = 1").select("row", F.explode("features").alias("feature")).join(names, "feature")
        for r in toxic.toLocalIterator():
            has[r["feature"]].add(r["row"])
    rules: dict[str, float] = {}
    covered: set[int] = set()
    while has:
        best = max(has, key=lambda f: (len(has[f]) * sure[f], -len(f), f))
        if len(has[best]) < 2:
            break
        rules[best] = sure[best]
        gain = has.pop(best)
        covered |= gain
        has = {f: rows - gain for f, rows in has.items() if rows - gain}
    missed = (got[1] - len(covered)) * weight[1]
    return ToxicityModel(model, rules, min(0.4, missed / (missed + sizes.get(0, 0) + 1)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``restored`` (words that
    were restored and spoke for label 1) per input row.

    Every word of the whole text is restored by the character model and looked up in the
    rules; the score joins the probabilities of the distinct words met. Words whose lattice
    has several paths are decoded once each; the others have one path, themselves. A null or
    empty text gets the base score. Rows that repeat an id are scored each; an empty table
    gives no rows; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Pickled by value, so that workers need no copy of this package.
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        m = cloudpickle.loads(held.value)
        for batch in batches:
            for part in words.slices(batch, 1):
                codes, found, offsets = restored_words(part.column(1), m.characters, seen)
                chance = np.fromiter(map(m.of_word, found), float, len(found))
                hot = np.flatnonzero(chance[codes] > 0)
                rows = np.searchsorted(offsets, hot, side="right") - 1
                scores = np.full(part.num_rows, m.base)
                spoke: list[list[str]] = [[] for _ in range(part.num_rows)]
                for mine in np.split(np.arange(len(hot)), np.flatnonzero(np.diff(rows)) + 1):
                    if len(mine):
                        row = rows[mine[0]]
                        spoke[row] = sorted({found[c] for c in codes[hot[mine]]})
                        scores[row] = m.joint([m.of_word(w) for w in spoke[row]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spoke, pa.list_(pa.string()))],
                    ["id", "score", "predicted", "restored"],
                )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(words.tidied(score), f"id {kind}, score double, predicted int, restored array<string>").withColumnRenamed("id", id_col)
