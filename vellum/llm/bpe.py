"""BPE encoding and decoding through a table of distinct words.

Between white space a tokenizer of the word kind never merges, so a text's ids are the
ids of its words one after another.  Texts are split into words in Spark; each distinct
word of the corpus is encoded once, and its ids are joined back to every position where
the word stands.  Decoding joins ids with the vocabulary's id-to-piece table.

How positions are joined: a task reads its rows in *blocks* (``DISTINCT`` distinct words or
``POSITIONS`` positions, whole texts).  In a block a word has a number, and a text is the
list of its words' numbers.  The words of a block go, with their numbers, to the bucket
that their hash names; there a word from all blocks is encoded once, and (block, number,
ids) goes back.  The texts' numbers meet the ids by block.  So what is shuffled is a block's
distinct words and less than two bytes a position; texts are read twice and never move.

Skew: a word comes once from each block however often it stands, so no word is hot beyond
the number of blocks; blocks are bounded (but for a single text beyond the bound).  Nothing is
broadcast but the vocabulary, and the driver receives nothing.

Rows must come in the same order when they are read again, as files give them: a block is
known by a hash of its texts.  Save what comes out of a shuffle first; a block whose words
are not found raises an error and never gives a wrong row.

Words are split at ASCII white space on UTF-8 bytes, and between a letter or digit and a
stop that closes a word; further white space stays inside a word and is dealt with by the
tokenizer itself.  Capitals are lowered first in words of ASCII alone, where no mark can
follow that the tokenizer would compose with a capital before it lowers.  Results equal
those for the text as a whole.

Defined cases: a null text is empty; the empty text has no ids and decodes to the
empty string; an id outside the vocabulary decodes to nothing; a null array of ids is
empty; repeated rows give repeated rows; further columns stay out of the result; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.common import partitions

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DISTINCT, POSITIONS = 130_000, 2_000_000  #: of a block
ROWS = 256  #: rows of a batch of results
PACKED = 8192  #: positions of a packed row, or one text
WIDE = 65535  #: numbers from here on are written apart
_CODEC = pa.Codec("zstd")


def load(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_ids(tokenizer: Tokenizer, words: list[bytes]) -> list[list[int]]:
    found = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return [e.ids for e in found]


_LETTER, _STOP, _END = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalnum()]] = True
_STOP[list(b".,;:!?")] = True
_END[list(b" \n")] = True


def _parted(text: bytes) -> bytes:
    """The text with a space before a stop that closes a word."""
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_STOP[a])
    closes = (at > 0) & _LETTER[a[at - 1]] & ((at + 1 == len(a)) | _END[a[np.minimum(at + 1, len(a) - 1)]])
    return np.insert(a, at[closes], 32).tobytes() if closes.any() else text


def split_words(text: bytes) -> list[bytes]:
    """Words that the tokenizer encodes one by one as it does the text.

    A text with the opening of a special token, whose case counts, is split at white space only.
    """
    if b"<|" in text:
        return text.split()
    if text.isascii():
        return _parted(text.lower()).split()
    return [w.lower() if w.isascii() else w for w in _parted(text).split()]


class Memo(dict):
    """Word to its ids as little-endian unsigned 32-bit numbers, of words that a worker has met.

    When it is full the words met last go: those in common use were met first.
    """

    def __init__(self, vocabulary: str, most: int):
        super().__init__()
        self.tokenizer, self.most = load(vocabulary), most

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids; the words that are new to the worker are encoded together."""
        words = [split_words(t) for t in texts]
        if len(self) > self.most:
            kept = dict(itertools.islice(self.items(), self.most // 2))
            self.clear()
            self.update(kept)
        new = [w for w in set().union(*words) if w not in self]
        self.update(zip(new, (np.array(x, "<u4").tobytes() for x in word_ids(self.tokenizer, new)), strict=True))
        return [b"".join(map(self.__getitem__, w)) for w in words]


@functools.lru_cache(maxsize=1)
def memo(vocabulary: str, most: int) -> Memo:
    """The worker's own, kept from task to task."""
    return Memo(vocabulary, most)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def packed(*arrays: np.ndarray, tail: bytes = b"") -> tuple[bytes, bytes]:
    """Arrays by planes of their bytes and a tail, compressed; and the sizes that ``unpacked`` needs."""
    raw = b"".join([x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b"" for x in arrays]) + tail
    return _CODEC.compress(raw, asbytes=True), np.array([len(raw), *map(len, arrays)], "<u4").tobytes()


def unpacked(data: bytes, sizes: bytes, *kinds: str) -> tuple:
    """The arrays and the tail."""
    size, *lengths = np.frombuffer(sizes, "<u4").tolist()
    raw, at, out = _CODEC.decompress(data, size, asbytes=True) if size else b"", 0, []
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        end = at + n * kind.itemsize
        out.append(np.frombuffer(raw[at:end], np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind))
        at = end
    return *out, raw[at:]


class Numbers(dict):
    """A word's number in its block, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], distinct: int) -> Iterator[tuple[bytes, Numbers, list[pa.RecordBatch], list[np.ndarray]]]:
    """(hash, words, rows without the text, each row's word numbers) of each block; the text is the last column."""
    mark, words, rows, numbers, held = hashlib.blake2b(digest_size=16), Numbers(), [], [], 0

    def kept(part: pa.RecordBatch, begin: int, end: int) -> pa.RecordBatch:
        return part.select(range(part.num_columns - 1)).take(pa.array(range(begin, end), pa.int64()))  # a copy, so that no text is held

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            begin = 0
            for i, text in enumerate(raw_texts(part.column(part.num_columns - 1)), 1):
                found = split_words(text)
                mark.update(b"%d " % len(text))
                mark.update(text)
                numbers.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(found)
                if len(words) >= distinct or held >= POSITIONS:
                    yield mark.digest(), words, [*rows, kept(part, begin, i)], numbers
                    mark, words, rows, numbers, held, begin = hashlib.blake2b(digest_size=16), Numbers(), [], [], 0, i
            if begin < part.num_rows:
                rows.append(kept(part, begin, part.num_rows))
    if rows:
        yield mark.digest(), words, rows, numbers


def _words(buckets: int, distinct: int):
    """(bucket, block, a, b: numbers and words packed) of each block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, words, _, _ in blocks(batches, distinct):
            every = list(words)
            bucket = np.fromiter(map(zlib.crc32, every), np.uint32, len(every)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)), len(order))
            groups = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            data = [packed(np.diff(g, prepend=0).astype("<u4"), tail=b"\n".join([every[i] for i in g])) for g in groups]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
                    pa.array([mark] * len(groups), pa.binary()),
                    pa.array([d for d, _ in data], pa.binary()),
                    pa.array([s for _, s in data], pa.binary()),
                ],
                names=["bucket", "block", "a", "b"],
            )

    return run


def _encoded(vocabulary: str, kind: str):
    """Of rows (bucket, block, a, b) sorted by bucket: (block, part 0, a, b: numbers, counts and ids packed); each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, last = load(vocabulary), {}, None
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            data = []
            for bucket, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                numbers, lines = unpacked(a, b, "<u4")
                words = lines.split(b"\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(x, kind) for x in word_ids(tokenizer, new)), strict=True))
                ids = [known[w] for w in words]
                data.append(packed(numbers, np.array([len(x) for x in ids], "<u4"), np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([0] * len(data), pa.int32()), pa.array([d for d, _ in data], pa.binary()), pa.array([s for _, s in data], pa.binary())], names=["block", "part", "a", "b"])

    return run


def _numbered(distinct: int):
    """(block, part 1, a, b: word numbers packed, rows, lengths) of some texts in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, _, rows, numbers in blocks(batches, distinct):
            begin = 0
            for part in rows:
                own = numbers[begin : begin + part.num_rows]
                begin += part.num_rows
                ends, cuts = np.cumsum([len(n) for n in own]), [0]
                while cuts[-1] < len(own):  # as many texts as hold PACKED positions, one at least
                    done = ends[cuts[-1] - 1] if cuts[-1] else 0
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + PACKED, side="right"))))
                data = []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    n = np.concatenate(own[i:j])
                    data.append(packed(np.minimum(n, WIDE).astype("<u2"), n[n >= WIDE].astype("<u4"), np.array([len(x) for x in own[i:j]], "<u4")))
                texts = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([mark] * len(data), pa.binary()),
                        pa.array([1] * len(data), pa.int32()),
                        pa.array([d for d, _ in data], pa.binary()),
                        pa.array([s for _, s in data], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts),
                    ],
                    names=["block", "part", "a", "b", "rows"],
                )

    return run


class Table:
    """The words of one block: the ids of all, and each one's first place and number of ids."""

    def __init__(self, rows: list[tuple[bytes, bytes]], kind: str):
        data = [unpacked(a, b, "<u4", "<u4", kind) for a, b in rows]
        number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(n, dtype=np.int64) for n, *_ in data)])
        count = np.concatenate([np.zeros(0, np.int64), *(c.astype(np.int64) for _, c, *_ in data)])
        self.ids = np.concatenate([np.zeros(0, kind), *(x for _, _, x, _ in data)])
        self.first, self.count = np.zeros(number.max(initial=-1) + 1, np.int64), np.full(number.max(initial=-1) + 1, -1)
        self.first[number], self.count[number] = np.cumsum(count) - count, count

    def check(self, numbers: np.ndarray) -> None:
        if len(numbers) and (numbers.max() >= len(self.count) or self.count[numbers].min() < 0):
            raise RuntimeError("a block's words are missing: the rows came in another order when they were read again; save them first")

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a text's words one after another."""
        n = self.count[numbers]
        return self.ids[np.repeat(self.first[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def joined(self, pieces: list[bytes]) -> list[bytes]:
        """Each word's pieces, joined by spaces."""
        out = list(map(pieces.__getitem__, self.ids.tolist()))
        return [out[f] if c == 1 else b" ".join(out[f : f + max(c, 0)]) for f, c in zip(self.first.tolist(), self.count.tolist(), strict=True)]


def _met(kind: str, finish: Callable, names: list[str]):
    """Rows sorted by block and part: what ``finish`` makes of rows, their numbers and the block's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, table, held = None, [], None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                block, part = some.column(0).to_pylist(), some.column(1).to_pylist()
                starts = [i for i in range(len(block)) if i == 0 or (block[i], part[i]) != (block[i - 1], part[i - 1])]
                for i, j in zip(starts, [*starts[1:], len(block)], strict=True):
                    if block[i] != last:
                        last, parts, table, held = block[i], [], None, {}
                    rows = some.slice(i, j - i)
                    if part[i] == 0:
                        parts += zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
                        continue
                    if table is None:
                        table, parts = Table(parts, kind), []
                    for k, (a, b) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                        n, wide, lengths, _ = unpacked(a, b, "<u2", "<u4", "<u4")
                        n = n.astype(np.int64)
                        n[n == WIDE] = wide
                        table.check(n)
                        kept = rows.column(4).slice(k, 1).flatten()
                        yield from finish(dict(zip(names, kept.flatten(), strict=True)), np.split(n, np.cumsum(lengths)[:-1]), table, held)

    return run


def joined(docs: DataFrame, keep: list[str], finish: Callable, schema: str, vocabulary: str = VOCABULARY, text_col: str = "text", distinct: int = DISTINCT) -> DataFrame:
    """``finish(kept columns, word numbers of each row, Table, dict of the block)`` over all rows, their words' ids joined by position."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kind = "<u2" if load(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    row = f"array<struct<{', '.join(f'`{c}`: {docs.schema[c].dataType.simpleString()}' for c in keep)}>>"
    words = docs.select(F.col(text_col).alias("_text")).mapInArrow(_words(max(256, 4 * parts), distinct), "bucket int, block binary, a binary, b binary")
    ids = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(vocabulary, kind), "block binary, part int, a binary, b binary")
    numbered = rows.mapInArrow(_numbered(distinct), f"block binary, part int, a binary, b binary, rows {row}")
    both = ids.withColumn("rows", F.lit(None).cast(row)).unionByName(numbered)
    return both.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(_met(kind, finish, keep), schema)


def _kinds(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def encode(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``ids`` (array<int>), as the tokenizer gives them without special tokens."""

    def finish(kept: dict, numbers: list[np.ndarray], table: Table, held: dict) -> Iterator[pa.RecordBatch]:
        ids = [table.of(n).astype(np.int32) for n in numbers]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*kept.values(), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], names=[*keep, "ids"])

    return joined(docs, keep, finish, f"{_kinds(docs, keep)}, ids array<int>", vocabulary, text_col)


def pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """The vocabulary's id-to-piece table: as many rows as it has ids."""
    tokenizer = load(vocabulary)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def decode(encoded: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` with ``decoded``: pieces joined by spaces, as a tokenizer without decoder does.

    The id-to-piece table is one broadcast row that every row is joined with; ids look their pieces up in it.
    """
    spark = encoded.sparkSession
    table = F.broadcast(spark.createDataFrame([(pieces(vocabulary),)], "_pieces array<string>"))
    piece = lambda i: F.get("_pieces", i)
    known = F.filter(F.transform(F.coalesce("ids", F.array().cast("array<int>")), piece), lambda p: p.isNotNull())
    return encoded.select(*keep, "ids").join(table).select(*keep, F.array_join(known, " ").alias("decoded"))


def op4(docs: DataFrame, vocabulary: str = VOCABULARY, distinct: int = DISTINCT) -> DataFrame:
    """The contract's digests: of each word's ids and pieces, made once in a block, and joined by position."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = docs.sparkSession.sparkContext.broadcast([p.encode() for p in pieces(vocabulary)])

    def finish(kept: dict, numbers: list[np.ndarray], words: Table, held: dict) -> Iterator[pa.RecordBatch]:
        if not held:
            held["decimal"] = words.joined([str(i).encode() for i in range(len(table.value))])
            held["piece"] = words.joined(table.value)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for n in numbers:
            n = n[words.count[n] > 0]
            out["n_tokens"].append(int(words.count[n].sum()))
            n = n.tolist()
            for name, of in (("ids_sha256", held["decimal"]), ("decoded_sha256", held["piece"])):
                out[name].append(hashlib.sha256(b" ".join(map(of.__getitem__, n))).hexdigest())
        yield pa.RecordBatch.from_arrays([kept["doc_id"], pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())], names=["doc_id", *out])

    return joined(rows, ["doc_id"], finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary, distinct=distinct)
