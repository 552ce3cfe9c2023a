"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of tokens that are popped when it is taken,
both worked out beforehand, so a word's greedy longest-match length is found in one pass over its characters: no
step back, and no piece is ever built. Words start with a marker character that word-initial pieces carry; a
character that is no piece counts as its UTF-8 bytes (byte fallback), so every text has a length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import binary_column

MARK = "▁"
CACHE = 200_000


class Automaton:
    """Greedy longest-match lengths over ``pieces`` (distinct non-empty strings)."""

    def __init__(self, pieces):
        weight = dict.fromkeys((p for p in pieces if p), 1)
        for ch in {c for p in weight for c in p}:
            weight.setdefault(ch, len(ch.encode()))  # byte fallback inside the alphabet
        self.step: list[dict[str, int]] = [{}]
        cost: list[int | None] = [None]
        for p, w in weight.items():
            at = 0
            for ch in p:
                nxt = self.step[at].get(ch)
                if nxt is None:
                    nxt = self.step[at][ch] = len(self.step)
                    self.step.append({})
                    cost.append(None)
                at = nxt
            cost[at] = w
        self.fail, self.pops = [0] * len(self.step), [0] * len(self.step)
        level = [(at, 0, ch) for ch, at in self.step[0].items()]
        while level:  # breadth first: links of shorter strings are known
            below = []
            for at, up, ch in level:
                if cost[at] is not None:  # the whole string is a piece: pop it, start anew
                    self.fail[at], self.pops[at] = 0, cost[at]
                else:  # pop what the parent pops until the character fits
                    z, n = self.fail[up], self.pops[up]
                    while ch not in self.step[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    self.fail[at], self.pops[at] = self.step[z][ch], n
                below += [(nxt, at, c) for c, nxt in self.step[at].items()]
            level = below

    def length(self, word: str) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        at = n = 0
        for ch in word:
            nxt = step[at].get(ch)
            while nxt is None:
                if not at:  # no piece holds this character
                    n += len(ch.encode())
                    nxt = 0
                else:
                    n += pops[at]
                    at = fail[at]
                    nxt = step[at].get(ch)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, pieces: list[str], mark: str = MARK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words (runs of non-blank bytes ``[^\\x20\\x09-\\x0D]+``), n_tokens (greedy
    longest-match pieces of all words, each with ``mark`` before it) and max_word_tokens (of its longest word; 0
    without words).

    Null and empty texts have 0 words and 0 tokens; repeated rows each get a row; extra columns are ignored. The
    vocabulary goes to the tasks as a broadcast (its size does not depend on the corpus). Words are counted once for
    each worker's bounded cache, which never changes a result."""
    held = docs.sparkSession.sparkContext.broadcast(list(pieces))
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        auto = Automaton(held.value)
        known: dict[bytes, int] = {}
        for b in batches:
            n_words, n_tokens, most = [], [], []
            for t in binary_column(b, "text"):
                words = t.split() if t else []
                if len(known) > CACHE:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = auto.length(mark + w.decode())
                lengths = [known[w] for w in words]
                n_words.append(len(words))
                n_tokens.append(sum(lengths))
                most.append(max(lengths, default=0))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, most))],
                ["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, max_word_tokens bigint")
