"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces of ``window`` ids and then into the binary digits of the rest, longest
first. A piece is a training sequence of its own: its length is a power of two, it holds ids of one document only,
and equal lengths form a bucket from which batches of equal shape are drawn, so nothing is padded.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import give_back

#: Distinct words that a Python worker keeps at most; a full cache starts anew. It never changes a result.
CACHE = 200_000


def piece_lengths(n: int, window: int) -> list[int]:
    """Powers of two that sum to ``n``: as many of ``window`` as fit, then the binary digits of the rest."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


#: A letter with marks after it: the tokenizer splits there. An apostrophe may start a contraction and stays.
_LETTERS_MARKS = r"([a-z])([!-&(-/:-@\[-`{-~]+)"


class WordEncoder:
    """Ids of texts from the ids of their blank-separated words.

    Right for tokenizers that lower-case, drop white space and split letters from marks before they merge; each
    distinct word is encoded once. Words are split, lower-cased (A-Z) and numbered by Arrow, a word's ids lie in one
    array for all words, and a batch's ids are one gather from it."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.number: dict[str, int] = {"": 0}
        self.ids, self.used = np.empty(1 << 16, dtype="<u4"), 0
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, words: list[str], ids, lengths) -> None:
        import numpy as np

        n, m = len(self.number), len(words)
        while n + m > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.number.update(zip(words, range(n, n + m), strict=True))
        self.ids[self.used:self.used + len(ids)] = ids
        self.length[n:n + m] = lengths
        self.start[n:n + m] = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.used += len(ids)

    def _one_by_one(self, words: list[str]) -> None:
        import numpy as np

        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.array([i for ids in coded for i in ids], dtype="<u4"), np.array([len(c) for c in coded]))

    def _learn(self, words: list[str]) -> None:
        """Words of letters only are encoded many at a time and told apart by the tokens that end a word."""
        import numpy as np

        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        parts = [letters[at:at + 500] for at in range(0, len(letters), 500)]
        coded = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, coded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                self._add(part, ids, np.diff(stops, prepend=0))
            else:  # a letter that lower-cases to several tokens
                self._one_by_one(part)
        if rest:
            self._one_by_one(rest)

    def __call__(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow string array, as little-endian unsigned 32-bit bytes; none for null."""
        from itertools import repeat

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        own = pc.match_substring(texts, "<|")  # may hold a special token, which is matched before anything else
        whole = {i: self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                 for i in np.flatnonzero(own.to_numpy(zero_copy_only=False))}
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(own, "", texts)), _LETTERS_MARKS, r"\1 \2")
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > CACHE:
            self.forget()
        numbers = np.fromiter(map(self.number.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self._learn([distinct[i] for i in new])
            numbers = np.fromiter(map(self.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = numbers[words.indices.to_numpy()]
        lengths = self.length[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.repeat(self.start[at] - ends[:-1], lengths) + np.arange(ends[-1])
        ids = self.ids[pick]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [np.array(whole[i], dtype="<u4").tobytes() if i in whole else ids[bounds[i]:bounds[i + 1]].tobytes()
                for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(spec: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return WordEncoder(spec)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length (a power of two up to
    ``window``), ids_crc32, doc_tokens (the document's ids with the end id), bucket (log2 of length), sequence_id,
    offset (0: a sequence is one piece), and with ``keep_ids`` the ids.

    Every document ends with ``end_id``; a null or empty text is that id alone, one piece of length 1. Repeated rows
    are separate documents; extra columns are ignored; an empty table gives no rows. The tokenizer file is read by
    the driver and sent to the tasks (a few MB, whatever the corpus)."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(spec.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                row, start, length, crc, total = [], [], [], [], []
                raws = [raw + end for raw in encode(b.column("text"))]
                for d, raw in enumerate(raws):
                    n, s = len(raw) // 4, 0
                    for k in piece_lengths(n, window):
                        piece = raw[4 * s:4 * (s + k)]
                        row.append(d)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        s += k
                cols = [b.column("doc_id").take(pa.array(row, pa.int64())),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:  # the pieces follow each other in the documents' ids
                    offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
                    ids = np.frombuffer(b"".join(raws), dtype="<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    out = src.mapInArrow(run, schema)
    return out.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(),
                            "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder for each length; a trainer reads a folder for batches of that shape."""
    pieces.write.partitionBy("bucket").parquet(path)


def bucketed(pieces: DataFrame, path: str) -> DataFrame:
    """The same sequences, written to ``path`` by :func:`write_buckets` and read again, so each file holds sequences of
    one length; ``sequence_id`` is fixed by the write."""
    write_buckets(pieces, path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(*pieces.columns)
