"""Phrase collocation mining by top-order marginalisation.

Each word position gives one row of lead-window columns: the word and the words after it, up to the longest phrase and
padded with null where its piece ends. Only these longest windows are counted. A ROLLUP over the columns then sums them
to all shorter phrases, since every occurrence of a phrase begins exactly one window. Windows are counted slab by slab
in the tasks, travel as one text for each first word, and meet there; windows that begin alike but are too rare to
matter are merged into one, so the ROLLUP sees few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobframe.llm.common import cut, give_back, maybe_broadcast

#: Marks that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text that a task counts at once, bytes of windows that it merges at once, and rows that it hands on at once.
SLAB, MERGE, ROWS = 8 << 20, 4 << 20, 50_000
#: Documents looked at to find words and pairs so common that their windows must be spread over tasks (those with more
#: than a share of 1 / (COMMON * shuffle partitions)), and over how many. This decides only where windows are counted,
#: never a count.
SAMPLE_DOCS, COMMON, SPREAD = 4_000, 4, 64
#: Stands for words whose phrase is below the limit; no word holds a blank.
RARE = " "
#: Salted groups that one group of the next level ranks.
FAN = 16

_BYTES = bytes(0x2E if b in BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _sums(cols, sizes, weights):
    """(first row, row -> group, sum of weights) of the distinct rows of code columns."""
    import numpy as np

    key, span = np.zeros(len(cols[0]), dtype=np.int64), 1
    for c, s in zip(cols, sizes, strict=True):
        if span * s >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            span = int(key.max()) + 1
        key, span = key * s + c, span * s
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), dtype=np.int64)
    np.add.at(sums, group, weights)
    return first, group, sums


def _tokens(texts):
    """(words as codes, their document, the dictionary, the code of a break) of an Arrow array of texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    a = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = a.buffers()
    low = pa.py_buffer(memoryview(data).tobytes().translate(_BYTES) if data else b"")
    a = pa.LargeStringArray.from_buffers(len(a), ends, low, None, 0, a.offset)
    split = pc.ascii_split_whitespace(pc.replace_substring(a, ".", " . "))
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    ends = split.offsets.to_numpy()
    doc = np.repeat(np.arange(len(a)), np.diff(ends))
    blank, stop = (words.dictionary.index(pa.scalar(x, words.dictionary.type)).as_py() for x in ("", "."))
    if blank >= 0:
        real = code != blank
        code, doc = code[real], doc[real]
    return code, doc, words.dictionary, stop


def _lead_columns(code, doc, stop: int, size: int):
    """Columns of each position's word and the words after it in its piece (-1 past its end), breaks left out."""
    import numpy as np

    here = code != stop
    cols, alive = [code[here]], here
    for j in range(1, size):
        ahead = np.full(len(code), -1, dtype=np.int64)
        if len(code) > j:
            ahead[:-j] = np.where(doc[j:] == doc[:-j], code[j:], -1)
        ahead[ahead == stop] = -1
        alive = alive & (ahead >= 0)
        cols.append(np.where(alive, ahead, -1)[here])
    return cols, doc[here]


def _scan(docs: DataFrame, size: int, hand_on, schema: str) -> DataFrame:
    """``hand_on(languages, lang, words, columns, n)`` for the distinct windows of each slab of texts, ordered by
    language and first word: dictionaries, codes into them and counts."""
    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.col("text").cast("string").alias("text"))

    def count(held):
        import numpy as np
        import pyarrow as pa

        texts, langs = (pa.concat_arrays([b.column(c) for b in held]) for c in ("text", "lang"))
        code, doc, words, stop = _tokens(texts)
        cols, doc = _lead_columns(code, doc, stop, size)
        if len(doc):
            langs = langs.dictionary_encode()
            lang = langs.indices.to_numpy()[doc].astype(np.int64)
            sizes = [len(langs.dictionary), *[len(words) + 1] * size]
            first, _, n = _sums([lang, *(c + 1 for c in cols)], sizes, np.ones(len(doc), dtype=np.int64))
            yield from hand_on(langs.dictionary, lang[first], words, [c[first] for c in cols], n)

    def run(batches):
        held, bytes_ = [], 0
        for b in batches:
            held.append(b)
            bytes_ += b.column("text").nbytes
            if bytes_ >= SLAB:
                yield from count(held)
                held, bytes_ = [], 0
        if held:
            yield from count(held)
        give_back()

    return src.mapInArrow(run, schema)


def _take(words, code):
    """Words of codes, null for -1."""
    import pyarrow as pa

    return words.take(pa.array(code, mask=code < 0)).cast(pa.string())


def _common(docs: DataFrame) -> dict[tuple[str, str], set[str]]:
    """(language, word) -> the words after it: those words and pairs that a sample of documents shows to be common."""
    import pyarrow as pa

    def pairs(languages, lang, words, cols, n):
        yield pa.RecordBatch.from_arrays([_take(languages, lang), *(_take(words, c) for c in cols), pa.array(n)],
                                         ["lang", "w1", "w2", "n"])

    rows = docs.count()
    sample = docs if rows <= SAMPLE_DOCS else docs.sample(SAMPLE_DOCS / rows, seed=1)
    found = _scan(sample, 2, pairs, "lang string, w1 string, w2 string, n bigint").rollup("lang", "w1", "w2").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g"))
    found = cut(found)
    total = (found.where("g = 7").first() or {"n": 0})["n"] or 0
    share = total / (COMMON * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common: dict[tuple[str, str], set[str]] = {}
    # for each language and word at most COMMON * partitions of each
    for r in found.where((F.col("g") <= 1) & (F.col("n") > share)).collect():
        pair = common.setdefault((r["lang"], r["w1"]), set())
        if r["g"] == 0 and r["w2"] is not None:
            pair.add(r["w2"])
    return common


_TRAVEL = "lang string, w1 string, part int, tails string"


def _travelling(size: int, sent):
    """One row for each language and first word of a slab: ``tails`` has a line for each window, the words after the
    first and, if it is not 1, the count after a tab. Common words take ``SPREAD`` rows, by the second word; windows
    of common pairs are spread by their third word too (``part`` above ``SPREAD``)."""

    def parts(languages, lang, words, cols):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part = np.zeros(len(lang), dtype=np.int64)
        common = sent.value
        if not common:
            return part
        place = {v: i for i, v in enumerate(languages.to_pylist())}
        known = pc.index_in(pa.array(sorted({w for _, w in common} | {x for s in common.values() for x in s}), words.type),
                            value_set=words)
        code = dict(zip(sorted({w for _, w in common} | {x for s in common.values() for x in s}), known.to_pylist(), strict=True))
        crc = np.array([zlib.crc32(w.as_buffer()) for w in words] + [0], dtype=np.int64)
        starts = lang * (len(words) + 1) + cols[0]
        for (g, w), nexts in common.items():
            if g not in place or code[w] is None:
                continue
            key = place[g] * (len(words) + 1) + code[w]
            lo, hi = np.searchsorted(starts, [key, key + 1])
            part[lo:hi] = 1 + crc[cols[1][lo:hi]] % SPREAD
            after = [code[x] for x in nexts if code[x] is not None]
            if after and size > 2:
                some = lo + np.flatnonzero(np.isin(cols[1][lo:hi], after))
                part[some] = 1 + SPREAD + (crc[cols[1][some]] + crc[cols[2][some]]) % SPREAD
        return part

    def hand_on(languages, lang, words, cols, n):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part = parts(languages, lang, words, cols)
        if part.any():
            order = np.lexsort((part, cols[0], lang))
            lang, part, n, cols = lang[order], part[order], n[order], [c[order] for c in cols]
        tail = pc.fill_null(_take(words, cols[1]), "")
        for c in cols[2:]:
            word = _take(words, c)
            longer = pc.binary_join_element_wise(tail, pc.fill_null(word, ""), " ")
            tail = pc.if_else(pc.is_valid(word), longer, tail)
        many = pc.binary_join_element_wise(tail, pa.array(n).cast(pa.string()), "\t")
        tail = pc.if_else(pa.array(n > 1), many, tail)
        new = np.flatnonzero((np.diff(lang) != 0) | (np.diff(cols[0]) != 0) | (np.diff(part) != 0)) + 1
        start = np.concatenate([[0], new])
        ends = pa.array(np.concatenate([start, [len(lang)]]).astype(np.int32))
        tails = pc.binary_join(pa.ListArray.from_arrays(ends, tail), "\n")
        for at in range(0, len(start), ROWS):
            s = start[at:at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [_take(languages, lang[s]), _take(words, cols[0][s]), pa.array(part[s], pa.int32()), tails.slice(at, ROWS)],
                ["lang", "w1", "part", "tails"])

    return hand_on


def _merge(size: int, least: int):
    """Windows that begin with the same word, from all tasks, counted; those below ``least`` are merged with others
    that begin alike, ``RARE`` standing for the word that makes them rare. The rows come ordered by first word."""

    def settle(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group = rows["group"]
        lines = pc.split_pattern(rows["tails"], "\n")
        owner = np.repeat(np.arange(len(group)), np.diff(lines.offsets.to_numpy()))
        line, n = lines.flatten(), np.ones(len(owner), dtype=np.int64)
        counted = pc.match_substring(line, "\t").to_numpy(zero_copy_only=False)
        if counted.any():
            both = pc.split_pattern(line.filter(pa.array(counted)), "\t").flatten()
            n[counted] = both.take(pa.array(np.arange(1, len(both), 2))).cast(pa.int64()).to_numpy()
            line = pc.replace_with_mask(line, pa.array(counted), both.take(pa.array(np.arange(0, len(both), 2))))
        words = pc.split_pattern(line, " ")
        ends, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        none = flat.dictionary.index(pa.scalar("", flat.dictionary.type)).as_py()
        cols, width = [group[owner]], [int(group.max()) + 1]
        for j in range(size - 1):
            at = ends[:-1] + j
            inside = at < ends[1:]
            c = np.where(inside, code[np.minimum(at, len(code) - 1)], -1)
            cols.append(np.where(c == none, -1, c) + 2 if none >= 0 else c + 2)  # 1: none, 0: rare
            width.append(len(flat.dictionary) + 2)
        first, _, n = _sums(cols, width, n)
        cols = [c[first] for c in cols]
        owner = owner[first]
        split = rows["part"][owner] > SPREAD
        rare = np.zeros(len(first), dtype=bool)
        for j in range(1, size):  # the shortest beginning that is too rare
            _, same, own = _sums(cols[:j + 1], width[:j + 1], n)
            few = (own[same] < least) & (cols[j] > 1) & ~rare
            if j == 1:
                few &= ~split
            cols[j] = np.where(rare, 1, np.where(few, 0, cols[j]))
            rare |= few
        first, _, n = _sums(cols, width, n)
        owner = owner[first]
        for at in range(0, len(first), ROWS):
            some = slice(at, at + ROWS)
            named = [flat.dictionary.take(pa.array(np.maximum(c[first[some]] - 2, 0), mask=c[first[some]] < 2)) for c in cols[1:]]
            named = [pc.if_else(pa.array(c[first[some]] == 0), RARE, x.cast(pa.string())) for c, x in zip(cols[1:], named, strict=True)]
            who = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays([rows["lang"].take(who), rows["w1"].take(who), *named, pa.array(n[some])],
                                             ["lang", *(f"w{i + 1}" for i in range(size)), "n"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows_of(batch):
            cols = {c: batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c)
                    for c in ("lang", "w1", "part", "tails")}
            keys = [cols[c].dictionary_encode().indices.to_numpy() for c in ("lang", "w1")] + [cols["part"].to_numpy()]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= np.diff(k) != 0
            return {**cols, "part": keys[2], "group": np.cumsum(new)}

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("tails").nbytes
            if size < MERGE:
                continue
            table = pa.Table.from_batches(held)
            group = rows_of(table)["group"]
            whole = int(np.searchsorted(group, group[-1]))  # the last word may go on
            if whole:
                yield from settle(rows_of(table.slice(0, whole).combine_chunks()))
            held = table.slice(whole).combine_chunks().to_batches()
            size = 0 if whole else -table.nbytes  # a word of many rows waits for as many again
        if held:
            yield from settle(rows_of(pa.Table.from_batches(held).combine_chunks()))
        give_back()

    return run


def windows(docs: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, w1 .. w<size>, n): the padded longest windows with their counts; where a beginning of one occurs less
    than ``least`` times its last word is ``RARE`` and what follows null, for all windows with such a beginning at once.
    A row may come more than once."""
    names = [f"w{i + 1}" for i in range(size)]
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))
    rows = _scan(docs, size, _travelling(size, sent), _TRAVEL)
    meet = ["lang", "w1", "part"]
    return rows.repartition(*meet).sortWithinPartitions(*meet).mapInArrow(
        _merge(size, least), f"lang string, {', '.join(f'{c} string' for c in names)}, n bigint")


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """(lang, size, phrase, f): the words of each language in all (size 0, phrase null), and every phrase of up to
    ``max_words`` words that occurs at least ``min_count`` times within pieces, overlaps included."""
    words = [f"w{i + 1}" for i in range(max_words)]
    summed = windows(docs, max_words, min_count).rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    size = F.lit(max_words) - F.bit_count("g")  # a bit for each column summed away
    summed = summed.where("lang is not null").select("lang", size.alias("size"), *words, "f")
    last = F.coalesce(*[F.when(F.col("size") == i + 1, F.coalesce(F.col(c), F.lit(RARE))) for i, c in enumerate(words)])
    kept = summed.where((F.col("size") == 0) | ((F.col("f") >= min_count) & (last != RARE)))
    phrase = F.when(F.col("size") > 0, F.concat_ws(" ", *[F.when(F.col("size") > i, F.col(c)) for i, c in enumerate(words)]))
    return kept.select("lang", "size", phrase.alias("phrase"), "f")


def _score(a, left, right):
    """floor(1000000 * a * a / (l * r)), in 38 digits."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    top = (F.lit(1_000_000).cast("decimal(38,0)") * big(a)).cast("decimal(38,0)") * big(a)
    return F.call_function("div", top.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)")).alias("score")


def _best(rows: DataFrame, order, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: salted groups first, so no task sorts a language."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    while salts > 1:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
        salts = -(-salts // FAN)
        rows = ranked.where(F.col("rank") <= top).withColumn("salt", F.pmod(F.col("salt"), F.lit(salts)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_words`` words of each language.

    A phrase's score is that of its lowest-scoring cut into two parts (ties to the shortest first part); phrases that
    lie inside a longer candidate with at least half their count are left out. Order: score and count falling, then
    the phrase's bytes. A-Z are lower-cased. A null language is ``und``; a null or empty text and an empty table give
    no words, a language without candidates no rows; repeated rows count each time; columns other than text and lang
    are ignored."""
    if not 2 <= max_words <= 62:
        raise ValueError("max_words must be from 2 to 62")
    found = cut(phrase_counts(docs, max_words, min_count))
    total = found.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = found.where("size > 0")
    known = maybe_broadcast(counts.select("lang", "phrase", "f"))
    words = F.split("phrase", " ")
    cand = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    join = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"),
                       join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", _score("a", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    longer = cand.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inside = longer.groupBy("lang", join(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("most"))
    left_over = best.join(inside, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 50 * a")
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    ranked = _best(left_over.select("lang", "phrase", "a", "cut"), order, top)
    return ranked.join(maybe_broadcast(total), "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
