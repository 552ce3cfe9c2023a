"""Best-fit packing by minimum bin slack.

Documents are turned into pieces of at most ``window`` ids. The number of pieces of each length, at most ``window``
rows whatever the corpus, is all that the plan needs: bin after bin takes the longest piece left, and a subset-sum over
the lengths that are left (a bit for each sum that can be reached) finds the fullest combination that goes with it. The
combination is used as often as the counts allow and is then removed. Spark numbers the pieces of each length, and the
plan gives each number its sequence and its place there.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobframe.llm.common import cut, give_back

#: Texts that are encoded and handed on at once.
SLICE = 500
#: The plan is looked up by length and number in one 64-bit key: length * 2**NUMBER + number.
NUMBER = 44


class ByteEncoder:
    """Ids of texts under a byte-level BPE that splits words by the common pattern, as the tokenizer file gives them.

    The merges of such a file are ranks, so a faster encoder of the same method can be built from it; texts that name
    an added token, and files of another kind, go through the tokenizer itself."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.fast, self.added = None, []
        parsed = json.loads(spec)
        model, split = parsed["model"], parsed.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ranks = [model["vocab"].get(a + b, -1) for a, b in merges]
        if (split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
                and not parsed.get("normalizer") and ranks == sorted(ranks) and -1 not in ranks):
            import public_tokenizers
            import tiktoken

            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that stand for themselves
            byte = {chr(b): b for b in shown}
            byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab,
                                          special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is not None and not any(a in text for a in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001 - the pattern gives up on extremely long runs of blanks
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def encoder(spec: str) -> ByteEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return ByteEncoder(spec)


def cuts(n: int, window: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: what does not fill a window comes first."""
    return [n % window] * (n % window > 0) + [window] * (n // window)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` as far as any choice from ``counts`` can.

    Bit s of ``sums`` says that some choice adds up to s; lengths are taken from the longest on and only until the room
    can be filled, so long pieces are placed while short ones remain to fill gaps."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, sums))
        left, step = min(counts[length], room // length), 1
        while left:  # chunks of 1, 2, 4, ... copies reach every number of them
            step = min(step, left)
            sums |= sums << (step * length) & mask
            left -= step
            step *= 2
        if sums >> room & 1:
            break
    chosen, at = {}, sums.bit_length() - 1
    for length, before in reversed(steps):
        k = 0
        while not before >> (at - k * length) & 1:
            k += 1
        if k:
            chosen[length] = k
            at -= k * length
    return chosen


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, each, sequence, offset): of the pieces of one length those numbered ``first`` to ``last``
    go, ``each`` to a sequence, to the sequences from ``sequence`` on, side by side from ``offset`` on.

    The number of combinations is bounded by the lengths (each use of one leaves fewer copies that still fit a
    window), so the plan does not grow with the corpus."""
    left = {x: n for x, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        chosen = fullest(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // k for x, k in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            k = chosen[x]
            rows.append((x, used[x], used[x] + times * k - 1, k, sequence, offset))
            offset += k * x
            used[x] += times * k
            left[x] -= times * k
            if not left[x]:
                del left[x]
        sequence += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth[, ids]): nth counts the earlier pieces of that length in the task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(spec.value)
        seen = [0] * (window + 1)
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                b = whole.slice(begin, SLICE)
                row, piece, start, length, crc, nth, parts = [], [], [], [], [], [], []
                for d, text in enumerate(b.column("text")):
                    ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                    s = 0
                    for p, k in enumerate(cuts(len(ids), window)):
                        part = ids[s:s + k]
                        row.append(d)
                        piece.append(p)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(part.tobytes()))
                        nth.append(seen[k])
                        seen[k] += 1
                        s += k
                        if keep_ids:
                            parts.append(part)
                cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, nth))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
                    values = np.concatenate(parts).astype("<i4") if parts else np.empty(0, "<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return src.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32,
    sequence_id, offset (its place there, gapless from 0), and with ``keep_ids`` the ids.

    Every document ends with ``end_id``; a null or empty text is that id alone. Only documents of more than ``window``
    ids are cut; their first piece may be shorter. Repeated rows are separate documents, equal lengths are served in
    the order of the table's partitions and rows, null ids stay null, extra columns are ignored and an empty table
    gives no rows. The tokenizer file (a few MB) and the plan (bounded by ``window``) are sent to the tasks; the
    driver sees one row for each length."""
    if not 0 < window < 1 << (63 - NUMBER):
        raise ValueError(f"window must be from 1 to {(1 << (63 - NUMBER)) - 1}")
    pieces = cut(cut_pieces(docs, tokenizer_path, window, end_id, keep_ids)
                 .withColumn("part", F.spark_partition_id()))
    per = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(plan(counts, window))
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    numbered = pieces.join(first, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("first"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if keep_ids else [])]
    numbered = numbered.select(*names)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        at = np.array(sent.value, dtype=np.int64).reshape(-1, 6)
        keys = (at[:, 0] << NUMBER) + at[:, 1]
        for b in batches:
            length, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            own = at[np.searchsorted(keys, (length << NUMBER) + nth, side="right") - 1]
            turn, slot = np.divmod(nth - own[:, 1], np.maximum(own[:, 3], 1))
            cols = [b.column(c) for c in names if c != "nth"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(own[:, 4] + turn), pa.array(own[:, 5] + slot * length)],
                [c for c in names if c != "nth"] + ["sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names if c != "nth")
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the training sequences of a packing that kept its ids, pieces in order. A group
    holds one window of ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")))
