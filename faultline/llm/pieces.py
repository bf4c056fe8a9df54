"""Pieces of a byte-fallback BPE vocabulary: exact counts at every prefix, encoding, decoding.

Text is marked first: a marker in front, and a marker for each space. A chunk is a run of
markers with the word or the signs behind it, up to the next marker or line feed. No piece
of the vocabulary joins two chunks: ``Vocabulary`` checks it, and where a text holds one of
the few characters whose pieces join words and signs, chunks end at markers and line feeds
only. So a text's ids are its chunks' ids in order, and each distinct chunk is segmented once per Python worker: the table lives as
long as the worker, over all its tasks. Beyond ``TABLE_CHARS`` characters of new chunks the
half that was not met again goes, which costs time but changes nothing. No row is shuffled, and nothing that grows
with the data reaches the driver.

The model file travels with the tasks as bytes, so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MARK = "▁"
TABLE_CHARS = 1_500_000
ROWS_OUT = 256

_CHUNKS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
_FINE_CHUNKS = re.compile(rf"{MARK}*(?:\w+|[^\w{MARK}\n]+)|\n|{MARK}+")
_WORD = re.compile(r"\w")
_LOADED: dict[str, "Vocabulary"] = {}

COUNT_SCHEMA = "n_bytes bigint, n_tokens bigint, prefix_deltas binary"


def read_model(path: str) -> bytes:
    """The vocabulary file, read once on the driver (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def vocabulary(model: bytes) -> "Vocabulary":
    """The vocabulary of this worker; it stays for later tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class ChunkTable:
    """What is known of distinct chunks; the less used half goes when the table is full."""

    def __init__(self):
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._size = 0

    def holding(self, chunks: list[str], learn: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """A mapping that holds all of these chunks; unknown ones are learnt, each once."""
        young = self._young
        missing = {c for c in chunks if c not in young}
        if not missing:
            return young
        old = self._old
        fresh = []
        for chunk in missing:
            if chunk in old:
                young[chunk] = old[chunk]
            else:
                fresh.append(chunk)
        if fresh:
            young.update(zip(fresh, learn(fresh)))
        self._size += sum(map(len, missing))
        if self._size > TABLE_CHARS:
            self._young, self._old, self._size = {}, young, 0
        return young


class Vocabulary:
    """A vocabulary with its tables of distinct chunks."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self.pieces = {library.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.pieces.items()}
        self.order = {p: -library.get_score(i) for p, i in self.pieces.items()}
        self.tails = {p[i:] for p in self.pieces for i in range(len(p))}
        self.pairs = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any((b == MARK and a != MARK) or "\n" in (a, b) for a, b in self.pairs):
            raise ValueError("pieces of this vocabulary cross whitespace markers")
        crossing = [(a, b) for a, b in self.pairs if MARK not in (a, b) and bool(_WORD.match(a)) != bool(_WORD.match(b))]
        joining = {c for pair in crossing for c in pair if _WORD.match(c)}
        self._joining = re.compile("[" + re.escape("".join(sorted(joining))) + "]") if joining else re.compile("(?!)")
        self.bytes = {int(library.id_to_piece(i)[1:-1], 16): i for i in ids if library.is_byte(i)}
        self.surface = [b""] * len(ids)
        for i in plain:
            self.surface[i] = library.id_to_piece(i).replace(MARK, " ").encode()
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        self._fits: dict[tuple[int, int], bool] = {}
        self._counts = ChunkTable()
        self._ids = ChunkTable()

    def chunks(self, text: str) -> list[str]:
        pattern = _CHUNKS if self._joining.search(text) else _FINE_CHUNKS
        return pattern.findall(marked(text))

    # Prefix counts

    def _merged(self, text: str) -> list[str]:
        """Merge the best pair until none is left; the vocabulary's own definition, for two pieces at most."""
        parts = list(text)
        while True:
            best = min(
                ((self.order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.order),
                default=None)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay as they are; left -1 asks for the right one alone."""
        known = self._fits.get((left, right))
        if known is None:
            parts = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            known = self._fits[left, right] = self._merged("".join(parts)) == parts
        return known

    def atom_counts(self, atom: str) -> list[int]:
        """Tokens of every prefix of a run of characters that pieces may join.

        Dynamic programme over the last token: the last token of a prefix is the one piece
        that ends there and stands next to the last token of what is before it.
        """
        pieces, tails, fits, fit = self.pieces, self.tails, self._fits, self._fit
        last, counts = [-1], [0]
        for end in range(1, len(atom) + 1):
            start = end - 1
            while start >= 0 and (tail := atom[start:end]) in tails:
                piece = pieces.get(tail)
                if piece is not None:
                    pair = last[start], piece
                    if fits[pair] if pair in fits else fit(*pair):
                        last.append(piece)
                        counts.append(counts[start] + 1)
                        break
                start -= 1
            else:
                raise ValueError(f"no piece ends {atom[:end]!r}")
        return counts[1:]

    def prefix_counts(self, chunk: str) -> list[int]:
        """Tokens of every non-empty prefix of a chunk."""
        cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1:i + 1] not in self.pairs), len(chunk)]
        counts: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            atom, before = chunk[a:b], counts[-1] if counts else 0
            if len(atom) == 1:
                counts.append(before + (1 if atom in self.pieces else len(atom.encode())))
                continue
            counts.extend(before + c for c in self.atom_counts(atom))
        return counts

    def _chunk_deltas(self, chunk: str) -> bytes:
        counts = self.prefix_counts(chunk)
        return bytes((b - a) & 0xFF for a, b in zip([0, *counts], counts))

    def deltas(self, text: str) -> bytes:
        """A signed byte per code point: how the count changes when the prefix takes it in.

        The count at prefix k is the sum of the first k bytes. One code point adds four
        bytes at most beside the first marker, and joins no more than a longest piece.
        """
        if not text:
            return b""
        chunks = self.chunks(text)
        table = self._counts.holding(chunks, lambda fresh: map(self._chunk_deltas, fresh))
        steps = b"".join(map(table.__getitem__, chunks))
        first = (steps[0] + steps[1]) & 0xFF
        return bytes([first]) + steps[2:]

    # Encoding and decoding

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the library, as little-endian 32-bit integers.

        The library puts a marker in front. A chunk with markers gives one up for it; any
        other goes behind a line feed, whose two ids are taken off.
        """
        inner = [c[1:] if c[0] == MARK else f"\n{c}" for c in chunks]
        out = []
        for chunk, text, ids in zip(chunks, inner, self.library.encode(inner, num_threads=1)):
            if chunk == MARK:
                ids = [self.pieces[MARK]]
            elif chunk[0] != MARK:
                ids = ids[2:]
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text without begin and end, as little-endian 32-bit integers."""
        for text in texts:
            chunks = self.chunks(text)
            yield b"".join(map(self._ids.holding(chunks, self._segment).__getitem__, chunks))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): surfaces joined, one marker's space taken off the front."""
        first = next((i for i in ids if self.surface[i]), None)
        if first is None or self.library.unk_id() in ids:
            return self.library.decode(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no character: the library says how they show
            return self.library.decode(ids)
        return text[1:] if first in self.text and text[0] == " " else text


def with_prefix_counts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and prefix_deltas: the exact token count of every prefix of a text.

    Null and empty texts have no bytes and no tokens. Columns of these names are replaced,
    all others kept; repeated rows are counted each.
    """
    @F.pandas_udf(COUNT_SCHEMA)
    def counted(texts: pd.Series) -> pd.DataFrame:
        vocab = vocabulary(model)
        texts = texts.fillna("")
        steps = [vocab.deltas(t) for t in texts]
        return pd.DataFrame({
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps],
            "prefix_deltas": steps,
        })

    return _unpacked(docs, counted(F.col(text)), ("n_bytes", "n_tokens", "prefix_deltas"))


def tokens_at(deltas: bytes | None, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    return int(np.frombuffer(deltas or b"", np.int8)[:max(0, length)].sum(dtype=np.int64))


def longest_prefix(deltas: bytes | None, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens; counts may fall as a prefix grows."""
    counts = np.cumsum(np.frombuffer(deltas or b"", np.int8), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def truncated(counted: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Cut texts to the longest prefix within the budget, from the stored counts alone.

    Adds n_kept (code points); null texts become empty.
    """
    @F.pandas_udf("bigint")
    def kept(deltas: pd.Series) -> pd.Series:
        return pd.Series([longest_prefix(d, budget) for d in deltas], dtype="int64")

    length = kept(F.col("prefix_deltas"))
    frame = counted.withColumn("n_kept", length)
    return frame.withColumn(
        text, F.coalesce(F.substring(F.col(text), F.lit(1), F.col("n_kept").cast("int")), F.lit("")))


def _framed(vocab: Vocabulary, texts: Iterable[str]) -> Iterator[bytes]:
    """Ids of each text between begin and end."""
    begin, end = (np.array([i], "<u4").tobytes() for i in (vocab.library.bos_id(), vocab.library.eos_id()))
    for code in vocab.encode_all(texts):
        yield begin + code + end


def with_ids(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add input_ids (with begin and end) and n_tokens; exactly the library's ids.

    Null and empty texts are a begin and an end. Columns of these names are replaced. Ids
    leave a task in parts of ``ROWS_OUT`` rows, so a batch of texts never has all its ids in
    memory.
    """
    kept = [c for c in docs.columns if c not in ("input_ids", "n_tokens")]
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                texts = (t or "" for t in part.column(part.num_columns - 1).to_pylist())
                codes = list(_framed(vocab, texts))
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], ids, pa.array(sizes)], names=[*kept, "input_ids", "n_tokens"])

    schema = T.StructType([*rows.drop("_text").schema.fields, T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(coded, schema)


def with_round_trip(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded again.

    ``ids_sha256`` is over the ids with begin and end as little-endian unsigned 32-bit
    integers, ``decoded_sha256`` over the decoded text in UTF-8. Ids and decoded texts live
    for one row only, so a batch of long texts needs little more than itself. Null texts are
    empty. Columns of these names are replaced.
    """
    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def tried(texts: pd.Series) -> pd.DataFrame:
        vocab = vocabulary(model)
        rows = [
            (len(c) // 4, hashlib.sha256(c).hexdigest(),
             hashlib.sha256(vocab.decode(np.frombuffer(c, "<u4").tolist()).encode()).hexdigest())
            for c in _framed(vocab, texts.fillna(""))]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return _unpacked(docs, tried(F.col(text)), ("n_tokens", "ids_sha256", "decoded_sha256"))


def decoded(ids: Column, model: bytes) -> Column:
    """Texts of id lists; a null list gives the empty text."""
    @F.pandas_udf("string")
    def texts(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(model)
        return pd.Series([vocab.decode([] if x is None else x.tolist()) for x in lists], dtype="object")

    return texts(ids)


def _unpacked(df: DataFrame, column: Column, names: tuple[str, ...]) -> DataFrame:
    kept = [c for c in df.columns if c not in names]
    packed = df.select(*kept, column.alias("_packed"))
    return packed.select(*kept, *(F.col(f"_packed.{n}").alias(n) for n in names))
