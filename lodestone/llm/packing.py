"""Tokenise documents and pack them into sequences: bounded-space online best fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import encoded, of, slices

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Parts of texts whose ids a Python worker keeps in each of two generations, some 50 MB, and the longest of them in bytes.
HELD, LONGEST = 1 << 18, 64
#: First and last code points of the signs beyond ASCII that some version of Unicode counts as white space, and of their invisible neighbours.
BLANK = ((0x80, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))


def _seen(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether the character that starts (step 1) or ends (step -1) at each place of UTF-8 bytes is not white space."""
    near = data[at]
    out = (near > 0x20) & (near < 0x80)
    far = np.flatnonzero(near >= 0x80)
    if not len(far):
        return out
    first = at[far]
    if step < 0:
        for _ in range(3):
            first = first - ((data[first] & 0xC0) == 0x80)
    lead, second, third = (data[np.minimum(first + k, len(data) - 1)].astype(np.int32) for k in range(3))
    two, three = (lead & 31) << 6 | second & 63, (lead & 15) << 12 | (second & 63) << 6 | third & 63
    code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0x10000))
    out[far] = ~np.logical_or.reduce([(code >= a) & (code <= b) for a, b in BLANK])
    return out


def lone_spaces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of spaces between two characters of one text that are not white space; ends are the texts' ends in the UTF-8 bytes."""
    at = np.flatnonzero(data == 0x20)
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[ends] = True
    at = at[~(edge[at] | edge[at + 1])]
    return at[_seen(data, at - 1, -1) & _seen(data, at + 1, 1)]


class Encoder:
    """The tokenizer of a vocabulary file, which reads each different part of the texts once.

    The tokenizer splits a text by its pattern and merges bytes within the pieces only. A lone space between two characters that are not white
    space always starts a piece: words, digits and signs take one space at their head and none inside. So a text's ids are those of its parts between
    such spaces, each with the space before it, one after the other, and parts met before need not be read again. When a generation of parts is
    full it becomes the one before, and those it is asked for again live on. Parts that are new are read
    together as one text, whose ids are told apart by their numbers of bytes: a byte-level token stands for as many bytes as its name has signs.
    A text that holds one of the vocabulary's added tokens, such as <|endoftext|>, goes through the tokenizer as a whole and by itself.
    """

    def __init__(self, path: str, most: int = HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole, self.most, self.held, self.old = Tokenizer.from_file(path), most, {}, {}
        self.added = [token.content.encode() for token in self.whole.get_added_tokens_decoder().values()]
        names = self.whole.get_vocab()
        self.bytes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.bytes[i] = len(name)

    def _read(self, parts: list[bytes], heads: list[bytes]) -> list[bytes]:
        """The ids of parts, which start with a lone space, and of heads of texts."""
        texts = [b"".join(parts), *heads]
        together, *apart = self.whole.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        ids = np.array(together.ids, "<u4")
        ends = np.cumsum([len(x) for x in parts])
        at = (4 * (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *at], at)] + [np.array(x.ids, "<u4").tobytes() for x in apart]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        raw = [x.encode() for x in texts]
        alone = [i for i, x in enumerate(raw) if any(token in x for token in self.added)]
        for i in alone:
            raw[i] = b""
        out = self._plain(raw)
        for i in alone:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _plain(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts without added tokens."""
        data, ends = b"".join(raw), np.cumsum([len(x) for x in raw], dtype=np.int64)
        if not data:
            return [b""] * len(raw)
        cuts = lone_spaces(np.frombuffer(data, np.uint8), ends)
        heads = np.unique(np.concatenate([[0], ends[:-1]]))
        heads = heads[heads < len(data)]
        bounds = np.sort(np.concatenate([heads, cuts, [len(data)]]))
        spans = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which, each = spans.indices.to_numpy(), spans.dictionary
        signs, places = each.buffers()[2].to_pybytes(), np.frombuffer(each.buffers()[1], np.int64, len(each) + 1).tolist()
        keys = [signs[a:b] for a, b in zip(places, places[1:])]

        inner = np.zeros(len(keys), bool)
        inner[which[np.searchsorted(bounds, cuts)]] = True
        held, old, new, first = self.held, self.old, [], []
        for key, part in zip(keys, inner.tolist()):
            if key not in held:
                if key in old:  # need not be read again
                    held[key] = old[key]
                else:
                    (new if part else first).append(key)
        held.update(zip(new + first, self._read(new, first)))
        ids = [held[key] for key in keys]

        sizes = np.array([len(x) for x in ids], np.int64) // 4
        lengths = sizes[which]
        after = np.cumsum(lengths)
        shift = (np.cumsum(sizes) - sizes)[which] - (after - lengths)
        out = np.frombuffer(b"".join(ids), "<u4")[np.arange(after[-1]) + np.repeat(shift, lengths)].tobytes()
        at = (4 * np.concatenate([[0], after])[np.searchsorted(bounds, ends)]).tolist()
        for x in chain(new, first):
            if len(x) > LONGEST:
                del held[x]
        if len(held) > self.most:
            self.old, self.held = held, {}
        return [out[a:b] for a, b in zip([0, *at], at)]


_made: dict[str, Encoder] = {}


def token_bytes(texts: list[str], name: str = TOKENIZER) -> list[bytes]:
    """The tokenizer's ids of whole texts; name is a file of public_tokenizers or a path. Its encoder is made once in a Python worker."""
    if name not in _made:
        import public_tokenizers

        _made[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _made[name].encode(texts)


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = SEQUENCE, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) and ids, if asked, as little-endian unsigned 32-bit bytes.

    Every document is its text's ids and then end_id; a null text counts as empty, so it has the one id. Only documents
    longer than length are cut; all pieces but the first then have that length. Repeated rows repeat.
    """
    end = np.array([end_id], "<u4").tobytes()
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            rows, piece, start, sizes, crc, ids = [], [], [], [], [], []
            texts = [x.decode("utf-8", "replace") for x in encoded(part.column(1))]
            for row, found in enumerate(token_bytes(texts, tokenizer)):
                data = found + end
                n = len(data) // 4
                at = n % length or length
                bounds = [0, *range(min(at, n), n + 1, length)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    mine = data[4 * a : 4 * b]
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    sizes.append(b - a)
                    crc.append(zlib.crc32(mine))
                    ids.append(mine)
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=schema.names)

    return docs.select(of(id_col), of(text_col).alias("text")).mapInArrow(run, schema)


class OpenBins:
    """At most `most` open bins. Bit f of `free` is set while some open bin has f free places."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.free, self.open, self.made = length, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, space: int) -> int:
        held = self.bins[space]
        found = held.pop()
        if not held:
            self.free &= ~(1 << space)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset): the open bin with the least space that is enough, else a new one; when all are open the fullest closes first."""
        if fits := self.free >> size:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
            self.open -= 1
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            found, space = self.made, self.length
            self.made += 1
        if left := space - size:
            self.bins[left].append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.length - space


def pack_pieces(pieces: DataFrame, tasks: int, length: int = SEQUENCE, open_bins: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; any columns beside `length` pass through.

    Rows are dealt round robin over `tasks`, and each task packs what it gets as it comes with its own bins; a
    sequence number holds the task's number in its upper bits. State is open_bins bins a task.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = np.array([bins.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places[:, 0] + base), pa.array(places[:, 1].copy())], names=[*batch.schema.names, "sequence_id", "offset"])

    return pieces.repartition(tasks).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, rows_per_task: int = 1 << 18, tokenizer: str = TOKENIZER, length: int = SEQUENCE, open_bins: int = 1024) -> DataFrame:
    """All documents as pieces with their place in a sequence: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The number of packing tasks follows the number of documents. Nulls, empty texts and repeats: see tokenize_pieces;
    an empty table gives no rows. Columns other than the id and the text are not read.
    """
    tasks = max(1, -(-docs.count() // rows_per_task))
    pieces = tokenize_pieces(docs, id_col, text_col, tokenizer, length, with_ids=with_ids)
    return pack_pieces(pieces, tasks, length, open_bins)
