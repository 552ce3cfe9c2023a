"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task. Its words become symbols (the words that the phrases use; all others
match nothing and cut the text into runs, and runs shorter than the shortest phrase cannot hold one and stay out).
The runs are suffix-sorted, their Burrows-Wheeler transform is stored as a wavelet matrix, and all test phrases are
searched backwards at once through its ranks. Occurrences are located by walking to sampled suffix positions, then
spans of hit words are merged. Phrases are held in blocks of bounded size; each block passes over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from jobframe.llm.common import alnum_words, binary_column, free_name, give_back

SAMPLE = 16


def suffix_array(text, barrier):
    """Suffix array of int symbols; a suffix ends at the first ``barrier`` position, and barriers sort by place."""
    import numpy as np

    n = len(text)
    order_bar = np.cumsum(barrier)
    rank = np.where(barrier, order_bar, text.astype(np.int64) + int(order_bar[-1]) + 1)
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64).reshape(-1)
    h = 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 2) + np.where(barrier, 0, nxt)
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        new = np.empty(n, dtype=np.int64)
        new[sa] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = new
        if rank[sa[-1]] == n - 1:
            return sa
        h *= 2


class WaveletMatrix:
    """Ranks over an int sequence, one bit level at a time; queries are arrays."""

    def __init__(self, seq, top: int):
        import numpy as np

        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for lv in range(self.levels - 1, -1, -1):
            bit = (seq >> lv) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c, i):
        """How often symbol c[j] stands before position i[j]."""
        import numpy as np

        start = np.zeros(len(c), dtype=np.int64)
        i = np.asarray(i, dtype=np.int64)
        for k, lv in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> lv) & 1).astype(bool)
            ones = self.ones[k]
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
            start = np.where(one, self.zeros[k] + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """FM-index of symbols >= 1; 0 is a barrier that no phrase holds. ``text`` must end with a barrier."""

    def __init__(self, text, top: int):
        import numpy as np

        barrier = text == 0
        sa = suffix_array(text, barrier)
        self.bwt = text[sa - 1].astype(np.int64)
        self.n = len(text)
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: top + 2]
        self.matrix = WaveletMatrix(self.bwt, top)
        sampled = (sa % SAMPLE == 0) | (self.bwt == 0) | (sa == 0)
        self.sampled = sampled
        self.order = np.cumsum(sampled) - 1
        self.places = sa[sampled]

    def search(self, phrases, lengths):
        """Row ranges [lo, hi) of each phrase; ``phrases`` is right-aligned."""
        import numpy as np

        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for step in range(width):
            live = live[(lengths[live] > step) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.first[c] + self.matrix.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows):
        """Text positions of index rows, by steps back to the next sampled position."""
        import numpy as np

        out = np.zeros(len(rows), dtype=np.int64)
        live, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled[row]
            out[live[done]] = self.places[self.order[row[done]]] + steps
            live, row = live[~done], row[~done]
            c = self.bwt[row]
            row = self.first[c] + self.matrix.rank(c, row)
            steps += 1
        return out


def phrase_table(items, window: int):
    """``items``: (item_id, text) rows. Returns the vocabulary, the distinct phrases (right-aligned symbols), their
    lengths, the (phrase, item) pairs and the item ids as strings."""
    import numpy as np

    vocab: dict[bytes, int] = {}
    seen: dict[tuple, int] = {}
    names: dict[str | None, int] = {}
    pairs = set()
    for item_id, text in items:
        words = [vocab.setdefault(w, len(vocab) + 1) for w in alnum_words(text)]
        if not words:
            continue
        name = names.setdefault(None if item_id is None else str(item_id), len(names))
        for i in range(max(1, len(words) - window + 1)):
            p = seen.setdefault(tuple(words[i:i + window]), len(seen))
            pairs.add((p, name))
    table = np.zeros((len(seen), max(window, 1)), dtype=np.int64)
    lengths = np.zeros(len(seen), dtype=np.int64)
    for p, at in seen.items():
        table[at, window - len(p):] = p
        lengths[at] = len(p)
    pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return vocab, table, lengths, pairs, list(names)


def shard_hits(words: list[list[bytes]], phrases):
    """Per document of a shard: merged spans [start, end) of hit words, hit words, and item numbers found."""
    from itertools import chain, repeat

    import numpy as np

    vocab, table, lengths, pairs, _ = phrases
    nothing = np.empty((0, 2), dtype=np.int64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])  # one barrier after each document
    n = int(base[-1])
    if not len(table) or not n:
        return [nothing] * len(words), np.zeros(len(words), np.int64), nothing
    ids = np.zeros(n, dtype=np.int64)
    flat = np.fromiter(map(vocab.get, chain.from_iterable(words), repeat(0)), dtype=np.int64, count=int(size.sum()))
    at = np.arange(len(flat)) + np.repeat(np.arange(len(words)), size)
    ids[at] = flat
    step = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= int(lengths.min())
    start, end = start[long], end[long]
    if not len(start):
        return [nothing] * len(words), np.zeros(len(words), np.int64), nothing
    run = end - start + 1  # each run with the barrier that follows it
    place = np.repeat(start - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(int(run.sum()))
    index = FMIndex(ids[place], len(vocab))
    lo, hi = index.search(table, lengths)
    found = hi - lo
    phrase = np.repeat(np.arange(len(table)), found)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(int(found.sum()))
    place = place[index.locate(rows)]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.add.reduceat(hit, base[:-1]) if len(words) else np.zeros(0, np.int64)
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)
    doc = np.searchsorted(base, spans[:, 0], side="right") - 1
    cuts = np.searchsorted(doc, np.arange(len(words) + 1))
    per_doc = [spans[cuts[d]:cuts[d + 1]] - base[d] for d in range(len(words))]
    in_doc = np.searchsorted(base, place, side="right") - 1
    hits = np.unique(np.stack([in_doc, phrase], axis=1), axis=0) if len(place) else nothing
    first = np.searchsorted(pairs[:, 0], np.arange(len(table) + 1))
    many = first[hits[:, 1] + 1] - first[hits[:, 1]]
    item_at = np.repeat(first[hits[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    items = np.unique(np.stack([np.repeat(hits[:, 0], many), pairs[item_at.astype(np.int64), 1]], axis=1), axis=0)
    return per_doc, n_hit, items


def cut_spans(text: bytes, spans) -> bytes:
    """The text without the bytes from each span's first word to the end of its last word."""
    import re

    marks = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, at = [], 0
    for s, e in spans.tolist():
        out.append(text[at:marks[s][0]])
        at = marks[e - 1][1]
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, block_chars: int):
    """The items in blocks of about ``block_chars`` characters (one block unless the table is larger than that)."""
    src = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    for k in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1].encode()) for r in part.toLocalIterator() if r[1]], k == n - 1


#: What a pass adds (the caller may rename them out of the way of the documents' own columns).
FOUND = ("n_words", "items", "spans")
FOUND_TYPES = ("bigint", "array<string>", "array<struct<first:bigint,last:bigint>>")


def _merged(spans, earlier):
    """Union of this block's spans and those that earlier blocks found, as [start, end) rows."""
    import numpy as np

    every = sorted([*map(tuple, spans.tolist()), *((s["first"], s["last"] + 1) for s in earlier)])
    out: list[list[int]] = []
    for s, e in every:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _search(docs: DataFrame, items: list, window: int, shard_words: int, clean: bool, found_names) -> DataFrame:
    """One block's pass: adds (or merges into) the columns of FOUND; with ``clean`` cuts the spans instead."""
    held = docs.sparkSession.sparkContext.broadcast(phrase_table(items, window))  # bounded by block_chars
    c_words, c_items, c_spans = found_names
    again = c_spans in docs.columns
    schema = docs.select(*[c for c in docs.columns if c not in found_names]).schema
    if not clean:
        for f in _parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in zip(found_names, FOUND_TYPES, strict=True))):
            schema = schema.add(f)
    names = schema.names

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        phrases = held.value
        kept, words, texts, count = [], [], [], 0

        def flush():
            spans, n_hit, items = shard_hits(words, phrases)
            found: list[set] = [set() for _ in words]
            for d, k in items.tolist():
                if phrases[4][k] is not None:
                    found[d].add(phrases[4][k])
            if again:
                for d, (s, i) in enumerate(zip(*([x for b in kept for x in b.column(c).to_pylist()]
                                                 for c in (c_spans, c_items)), strict=True)):
                    spans[d] = _merged(spans[d], s)
                    found[d] |= set(i)
            at = 0
            for b in kept:
                part = range(at, at + b.num_rows)
                at += b.num_rows
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                if clean:
                    new = [cut_spans(texts[d], spans[d]).decode() if len(spans[d]) else None for d in part]
                    hit = pa.array([x is not None for x in new], pa.bool_())
                    cols["text"] = pc.if_else(hit, pa.array(new, cols["text"].type), cols["text"])
                    if "n_chars" in cols:
                        n = pa.array([None if x is None else len(x) for x in new], pa.int64())
                        cols["n_chars"] = pc.if_else(hit, n.cast(cols["n_chars"].type), cols["n_chars"])
                else:
                    cols[c_words] = pa.array([len(words[d]) for d in part], pa.int64())
                    cols[c_items] = pa.array([sorted(found[d]) for d in part], pa.list_(pa.string()))
                    cols[c_spans] = pa.array(
                        [[{"first": s, "last": e - 1} for s, e in spans[d].tolist()] for d in part],
                        pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                own = binary_column(part, "text")
                w = [alnum_words(t) for t in own]
                kept.append(part)
                words += w
                texts += own if clean else []
                count += sum(map(len, w))
                if count >= shard_words:
                    yield from flush()
                    kept, words, texts, count = [], [], [], 0
        if kept:
            yield from flush()
        give_back()

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 250_000,
                  block_chars: int = 20_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a ``window``-word phrase of an
    item; a shorter item is one phrase), items (sorted distinct ids, as strings, of the items found) and spans
    (merged, first and last word).

    Null and wordless texts have no words, on either side; items with a null id mark words but are not listed; equal
    items all count; extra columns are ignored; repeated rows each get a row. ``shard_words`` bounds an index (a
    longer document is an index of its own); ``block_chars`` bounds the phrases held at a time."""
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for items, _ in _blocks(benchmark, block_chars):
        df = _search(df, items, window, shard_words, False, FOUND)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 250_000,
                  block_chars: int = 20_000_000) -> DataFrame:
    """``docs`` with the merged spans cut out of the texts (n_chars follows); same columns, same rows."""
    names = tuple(free_name(docs.columns, n) for n in FOUND)
    for items, last in _blocks(benchmark, block_chars):
        docs = _search(docs, items, window, shard_words, last, names)
    return docs
