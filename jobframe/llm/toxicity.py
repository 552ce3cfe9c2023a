"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Every distinct word becomes a lattice of what it may
stand for: look-alike digits and marks, repeated letters, letters set apart by blanks or marks. The Viterbi path
under the character model and the channel's costs is the restored word, and the restored text is scored: words and
word beginnings that mark toxic documents are learnt from labelled ones, and a logistic model of a document's
findings gives its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import cut, give_back
from jobframe.llm.training import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample

# Marks and digits that stand for letters.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ø": "o", "¢": "c"}
#: Letters of other scripts that look like Latin ones: in a word that also has Latin letters they may stand for those,
#: or for themselves.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
         "ɡ": "g", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "υ": "u"}
#: Costs (negative log probabilities) of the channel: a look-alike, a repeated letter, a mark put in between.
LOOK_COST, REPEAT_COST, MARK_COST = 2.5, 2.5, 3.0

EDGE, OTHER, SIZE = 0, 27, 28
CACHE = 250_000
#: Marks that a task counts before it passes the counts on.
HELD_MARKS = 30_000
#: Word beginnings of these lengths are evidence beside whole words.
STEMS = (4, 5, 6, 7)


@cache
def classes():
    """Character classes of the basic plane: 0 for no letter, 1 to 26 for a letter (accents aside), 27 for others."""
    import unicodedata

    import numpy as np

    out = np.full(65536, OTHER, dtype=np.int64)
    for cp in range(0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch.lower())[:1]
        out[cp] = ord(base) - 96 if "a" <= base <= "z" else OTHER if ch.isalpha() else EDGE
    out[0x2000:0x2070] = EDGE
    out[0x3000:0x3004] = EDGE
    return out


def letter_class(ch: str) -> int:
    cp = ord(ch)
    return int(classes()[cp]) if cp < 65536 else OTHER


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n): how often each class trigram stands in all texts; runs of non-letters are one edge. A task sums its
    texts before anything is shuffled."""

    def run(batches):
        import numpy as np
        total = np.zeros(SIZE**3, dtype=np.int64)
        table = classes()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                texts = [t for t in b.column("text").slice(at, 200).to_pylist() if t]
                cp = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype="<u4")
                c = table[np.minimum(cp, 65535)]
                c = c[(c != EDGE) | np.concatenate([[True], c[:-1] != EDGE])]
                c = np.concatenate([[EDGE], c, [EDGE]])
                total += np.bincount(c[:-2] * SIZE**2 + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    src = docs.select(F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """Costs of a letter class after two others: trigrams smoothed by bigrams, these by single classes."""

    def __init__(self, counts):
        import numpy as np

        n = np.zeros(SIZE**3)
        for code, k in counts:
            n[code] = k
        n = n.reshape(SIZE, SIZE, SIZE)
        one = n.sum(axis=(0, 1)) + 1.0
        one /= one.sum()
        two = n.sum(axis=0) + 20 * one
        two /= two.sum(axis=1, keepdims=True)
        three = n + 20 * two[None]
        three /= three.sum(axis=2, keepdims=True)
        self.cost = (-np.log(three)).tolist()

    def restore(self, word: str, apart: bool = False) -> str:
        """The Viterbi path through the word's lattice. Each character gives a letter, or (at a cost) nothing: a
        mark in between, or a letter that repeats the one before it. A word that is one plain path is itself. With
        ``apart`` the letters may be those of several words, and a blank may follow each."""
        steps = []
        mixed = any("a" <= ch <= "z" for ch in word)
        for ch in word:
            if ch in LOOKS:
                options = [(x, LOOK_COST) for x in LOOKS[ch]]
                options.append(("", MARK_COST))
            elif ch in ALIKE and mixed:
                options = [(ch, 0.0), (ALIKE[ch], LOOK_COST)]
            elif ch.isalpha():
                options = [(ch, 0.0)]
            else:
                options = [("", MARK_COST)]
            if steps and ch.isalpha() and ch == before:
                options.append(("", REPEAT_COST))
            steps.append(options)
            before = ch
        if not apart and all(len(o) == 1 and o[0][0] for o in steps):
            return word
        cost = self.cost
        best = {(EDGE, EDGE): (0.0, None, "")}  # last two classes -> cost, back pointer, letter
        for options in steps:
            new = {}
            for (a, b), node in best.items():
                base = node[0]
                for ch, price in options:
                    if ch:
                        c = letter_class(ch)
                        key, total = (b, c), base + price + cost[a][b][c]
                    else:
                        key, total = (a, b), base + price
                    if key not in new or total < new[key][0]:
                        new[key] = (total, node, ch)
                    if apart and ch:
                        key, total = (c, EDGE), total + cost[b][c][EDGE]
                        if key not in new or total < new[key][0]:
                            new[key] = (total, node, ch + " ")
            best = new
        _, node = min(((node[0] + (cost[a][b][EDGE] if b else 0.0), node) for (a, b), node in best.items()),
                      key=lambda x: x[0])
        out = []
        while node[1] is not None:
            out.append(node[2])
            node = node[1]
        return "".join(reversed(out))


#: Letters set apart: at least four single characters with one to three blanks or marks between them.
APART = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+(€£¡¢])(?:[ \t._*~-]{1,3}(?:[^\W_]|[@$!|+(€£¡¢])){3,}(?![^\s.,;:!?])")
_BLANKS = re.compile(r"[ \t._*~-]+")
_PLAIN_END = re.compile(r"(?:([^\w\s])\1+|[.,;:!?)\]}\"'*&%#|_~-])+$")
_PLAIN_START = re.compile(r"^(?:([^\w\s])\1+|[(\[{\"'*&%#|_~-](?=\w))+")
_REPEAT = re.compile(r"([^\W\d_])\1|[^\w]|\d|_|[" + "".join(ALIKE) + "]")


def strip_marks(word: str) -> str:
    return _PLAIN_END.sub("", _PLAIN_START.sub("", word))


class Restorer:
    """Restored words of texts, with a bounded cache of distinct words that never changes a result."""

    def __init__(self, model: CharModel, value=lambda w: w):
        self.model, self.value = model, value
        self.known: dict[str, object] = {}

    def word(self, token: str):
        core = strip_marks(token)
        if core and _REPEAT.search(core):
            core = self.model.restore(core)
        return self.value(core)

    def __call__(self, text: str | None) -> list:
        """The values of a text's restored words in order, then those of its runs of letters set apart."""
        if not text:
            return []
        text = text.lower()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for token in text.split():
            got = known.get(token)
            if got is None and token not in known:
                got = known[token] = self.word(token)
            out.append(got)
        for m in APART.finditer(text):
            words = self.model.restore(strip_marks(_BLANKS.sub("", m[0])), apart=True).split()
            out += [self.value(w) for w in words]
        return out


def marks_of(word: str) -> list[str]:
    """A word's evidence: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)] if word else []


def learn_marks(sample: DataFrame, model: CharModel, least: float = 0.35, z: float = 2.0) -> dict[str, float]:
    """Words and beginnings whose documents are toxic with a lower confidence bound above ``least``, and the log
    odds of that bound; from the sample's document counts."""

    def run(batches):
        restore = Restorer(model, marks_of)
        counts: dict[str, list[int]] = {}

        def take():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], ["mark", "clean", "toxic"])
            counts.clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                for mark in {m for ms in restore(text) for m in ms}:
                    counts.setdefault(mark, [0, 0])[label > 0] += 1
                if len(counts) > HELD_MARKS:
                    yield take()
        yield take()
        give_back()

    found = (sample.mapInArrow(run, "mark string, clean bigint, toxic bigint").groupBy("mark")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n = F.col("clean") + F.col("toxic")
    share = F.col("toxic") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rows = found.where("toxic >= 5").withColumn("low", low).where(F.col("low") > least).select("mark", "low").collect()
    from math import log

    floor = log(least / (1 - least))
    return {m: log(p / (1 - p)) - floor for m, p in rows}  # bounded by the sample's words


class ToxicityModel:
    def __init__(self, chars: CharModel, marks: dict[str, float]):
        self.chars, self.marks = chars, marks
        self.weights = [0.0] * (self.SIZE + 1)

    #: Strongest mark, whether it is a sure one, the four strongest together, number of marked words, their share.
    SIZE = 5
    SURE = 2.0

    def weight(self, word: str):
        """(weight, word) of a word with a mark, else None."""
        get, n = self.marks.get, len(word)
        found = [w for k in STEMS if k <= n and (w := get(word[:k])) is not None]
        if (w := get("=" + word)) is not None:
            found.append(w)
        return (max(found), word) if found else None

    def restorer(self) -> Restorer:
        return Restorer(self.chars, self.weight)

    @staticmethod
    def findings(values: list) -> list[float]:
        from math import log1p

        found = sorted((w for w, _ in {v for v in values if v}), reverse=True)
        n = sum(v is not None for v in values)
        best = max(found, default=0.0)
        return [best, float(best >= ToxicityModel.SURE), sum(found[:4]), log1p(len(found)), 10 * n / max(1, len(values))]

    def score(self, values: list[float]) -> float:
        from math import exp

        z = sum(w * x for w, x in zip(self.weights, [*self.findings(values), 1.0], strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Character counts over all texts; marks and weights from at most ``sample_rows`` labelled documents that are
    not held out (labels.toxic). The weights are fit on a third of the sample whose words the marks for that step
    were not learnt from. Without labels every score is 0.5."""
    chars = CharModel([tuple(r) for r in count_trigrams(docs).collect()])  # at most 28 ** 3 rows
    sample = cut(labelled_sample(docs, labels, "toxic", sample_rows))
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    trial = ToxicityModel(chars, learn_marks(sample.where(part != 0), chars))

    def run(batches):
        restore = trial.restorer()
        for b in batches:
            rows = [trial.findings(restore(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    rows = sorted(tuple(r) for r in sample.where(part == 0).mapInArrow(run, "x array<double>, label int").collect())
    model = ToxicityModel(chars, learn_marks(sample, chars))
    import numpy as np

    model.weights = fit_logistic(np.array([x for x, _ in rows], dtype=float).reshape(-1, model.SIZE),
                                 np.array([y for _, y in rows], dtype=float)).tolist()
    return model


def toxicity(model: ToxicityModel, text):
    """Column: the score of a text column."""
    held = text.cast("string")

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restore = model.restorer()
        for texts in batches:
            yield pa.array([model.score(restore(t)) for t in texts.to_pylist()], pa.float64())
        give_back()

    return score(held)


def restored(chars: CharModel, text):
    """Column: the restored text, its words joined by blanks."""
    @F.arrow_udf("string")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restore = Restorer(chars)
        for texts in batches:
            yield pa.array([" ".join(w for w in restore(t) if w) for t in texts.to_pylist()], pa.string())

    return words(text.cast("string"))


def rate(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    Only the text enters the score. Null and empty texts score as texts without findings; a null id counts as held
    out; repeated rows each get a row; extra columns are ignored; an empty table gives no rows."""
    model = fit(docs, labels, sample_rows)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; the same columns."""
    model = fit(docs, labels, sample_rows)
    return docs.where(toxicity(model, F.col("text")) < threshold)
