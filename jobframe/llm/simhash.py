"""SimHash near-duplicate detection by pigeonhole blocks.

Fingerprints are 64 bits wide and are cut into ``blocks`` pieces. Two fingerprints that differ in at most
``max_bits`` bits agree in at least ``blocks - max_bits`` pieces, so each fingerprint is keyed by every choice of
that many pieces; rows with the same key meet in one bucket, and the Hamming distance of each met pair is verified.
With the default of 6 blocks there are 15 keys of 21 or 22 bits. Buckets above ``chunk`` fingerprints are dealt out
as pairs of chunks, so no task ever holds more than two chunks of a bucket and every pair still meets. A bucket
yields links that span its verified clusters rather than all pairs, which is enough for exact components.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import binary_column, blank_words, cut, free_name, give_back
from jobframe.llm.components import connected_components

WIDTH = 4096 * 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles (see :func:`fingerprints`)."""
    import numpy as np
    import xxhash

    words = blank_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8", count=n).view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, WIDTH):
        ones += np.unpackbits(h[at:at + WIDTH], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of ``docs``: fp is the 64-bit SimHash as a signed long, text_hash is
    xxhash64 of the text.

    Words are runs of non-blank bytes with A-Z lower-cased; a text of fewer words than ``shingle`` is one shingle; a
    null or wordless text has fingerprint 0. Repeated shingles count each time. A bit is 1 if more than half of the
    shingle hashes have it. Columns other than doc_id and text are ignored."""
    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in binary_column(b, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])
        give_back()

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """One mask (as a signed long) for each choice of ``blocks - max_bits`` pieces of the 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(pieces, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucket_links(max_bits: int, flush: int = 100_000):
    """Rows sorted by bucket -> links (a, b) that span each bucket's verified clusters."""

    def links(group, fp):
        import numpy as np

        n = len(fp)
        left = np.searchsorted(group, group, side="right") - np.arange(n)  # rows from here to the bucket's end
        label = np.arange(n)
        out = []
        idx = np.flatnonzero(left > 1)
        d = 1
        while len(idx):
            near = idx[np.bitwise_count(fp[idx] ^ fp[idx + d]) <= max_bits]
            near = near[label[near] != label[near + d]]
            if len(near):
                out.append((near, near + d))
                while True:  # join the labels along the new links, then follow them to their roots
                    lo = np.minimum(label[near], label[near + d])
                    was = label.copy()
                    for side in (near, near + d):
                        np.minimum.at(label, was[side], lo)
                        np.minimum.at(label, side, lo)
                    while True:
                        up = label[label]
                        if (up == label).all():
                            break
                        label = up
                    if (label[near] == label[near + d]).all():
                        break
            d += 1
            idx = idx[left[idx] > d]
        if not out:
            return np.empty((2, 0), dtype=np.int64)
        return np.stack([fp[np.concatenate(x)].view(np.int64) for x in zip(*out, strict=True)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept_g, kept_f, rows = [], [], 0

        def emit(g, f):
            _, dense = np.unique(g, axis=0, return_inverse=True) if len(g) else (None, np.empty(0, np.int64))
            a, b = links(dense.reshape(-1), f)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept_g.append(np.stack([batch.column(c).to_numpy() for c in ("t", "key", "lo", "hi")], axis=1))
            kept_f.append(batch.column("fp").to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows < flush:
                continue
            g, f = np.concatenate(kept_g), np.concatenate(kept_f)
            change = np.flatnonzero((g[1:] != g[:-1]).any(axis=1))
            end = int(change[-1]) + 1 if len(change) else 0
            if end:
                yield emit(g[:end], f[:end])
            kept_g, kept_f, rows = [g[end:]], [f[end:]], len(g) - end
        if rows:
            yield emit(np.concatenate(kept_g), np.concatenate(kept_f))

    return run


def hamming_links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """Links (a, b) between the distinct values of column ``fp`` that differ in at most ``max_bits`` bits. Each
    link is verified; together the links join exactly the pairs' connected components, and a link between two
    values already joined inside a bucket may be left out."""
    keyed = fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(block_masks(max_bits, blocks))])).alias("k")).select("k.t", "k.key", "fp")
    large = (keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
             .select("t", "key", F.ceil(F.col("n") / chunk).alias("parts")))
    dealt = (keyed.join(large, ["t", "key"], "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)).cast("bigint"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
             .select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))
    group = ["t", "key", "lo", "hi"]
    return (dealt.repartition(*group).sortWithinPartitions(*group)
            .mapInArrow(_bucket_links(max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 6,
                    chunk: int = 2048) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, fp, component (a fingerprint that stands for the
    group), component_id (the smallest doc_id of the group, nulls aside).

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; groups are the connected
    components. Equal fingerprints (exact copies, all wordless texts, repeated rows) are always one group. An empty
    table gives no rows; a null doc_id gets a row like any other, and a group of null ids has a null component_id."""
    fps = cut(fingerprints(docs, shingle))
    comp = connected_components(hamming_links(fps, max_bits, blocks, chunk))
    own = (fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
           .join(comp.withColumnRenamed("node", "fp"), "fp", "left")
           .withColumn("component", F.coalesce("component", "fp")))
    first = own.groupBy("component").agg(F.min("first_id").alias("component_id"))
    table = own.select("fp", "component").join(first, "component")
    return fps.join(table, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept: the row with the smallest doc_id (null
    ids last), then the smallest text hash."""
    found = near_duplicates(docs, shingle, max_bits, blocks)
    best = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("s"))
    # one key for both steps, so the texts are shuffled once
    key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h.cast("string"))
    own = free_name(docs.columns, "_own")
    best = best.select(key(F.col("s.doc_id"), F.col("s.text_hash")).alias(own)).distinct()
    d = docs.withColumn(own, key(F.col("doc_id"), F.xxhash64("text")))
    return d.join(best, own, "left_semi").dropDuplicates([own]).drop(own)
