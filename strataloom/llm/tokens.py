"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

END = 0
#: Ids in a block; a block holds whole documents, so a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Distinct pieces of text that a worker keeps the ids of, some 150 bytes each. Beyond it the store starts
#: anew; results don't depend on it.
STORE = 1_200_000
#: Pieces of more characters are encoded when met and not kept.
KEPT = 64

#: Bytes of text that a worker encodes at once.
GATHER = 8 << 20

#: Marks, within this module, a piece that does not begin with a space.
BARE = "\x01"
#: Texts with one of these are not cut at single spaces: the mark itself, white space other than the space and the
#: newline, and runs of white space.
_UNEVEN = r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
_FOREIGN = re.compile(r"[^\S \t\n\x0b\x0c\r]")
_CUT = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
#: A mark at a word's end is a token of its own.
_STOP, _STOPPED = r"([\pL\pN])([.,])([ \n]|$)", rf"\1 {BARE}\2\3"
#: Letters below this code point are letters in every version of Unicode that a pre-tokenizer may know.
OLD = 0x530
#: Texts on which the encoding by pieces must agree with that of whole texts before it is used.
PROBES = (
    "One two, three. It's 2 o'clock\nline\nα βγ été. x1y2 don't stop,now 3.5 end.", " lead and trail ", "a\n b \nc\n\nd  e\tf", "naïve—dash “quoted” #tag @x a_b",
    "\n", "...", "a\u3000b\u00a0c", "word\x01word", "日本語 テキスト 中中", "A.\nB,\nC")


class Encoder:
    """Whole-text ids of a file of the tokenizers library, each distinct piece encoded once.

    With the pre-tokenizer of byte-level BPE files a new token starts before every run of white space, at a newline that
    stands alone and after it, and between letters and marks; merges never cross its tokens. So a text may be cut there, and
    the ids of the pieces, joined, are those of the whole text. A file on whose PROBES the two differ, or that normalises
    or adds, gets whole texts, and so does a text with the string of a special token (which the library finds in texts).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        alphabet = sorted(map(ord, pre_tokenizers.ByteLevel.alphabet()))
        own = [c for c in alphabet if c < 256]
        beyond = iter(c for c in alphabet if c >= 256)
        self.byte_marks = {b: b if b in set(own) else next(beyond) for b in range(256)}
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids
        self._empty()
        self.by_words = False
        if self.tok.normalizer is None and len(self.newline) == 1:
            self.by_words = True
            whole = [e.ids for e in self.tok.encode_batch_fast(list(PROBES), add_special_tokens=False)]
            self.by_words = [np.frombuffer(x, "<u4").tolist() for x in self.encode(list(PROBES))] == whole

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.length = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.pool, self.filled = np.zeros(4096, dtype="<u4"), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces: words of old letters by the model itself, as they are one token of the pre-tokenizer."""
        out: list[list[int] | None] = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            bare = p[:1] == BARE
            word = p[1:] if bare else p
            if word.isalpha() and (word.isascii() or max(word) < chr(OLD)):
                raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_marks)
                out[i] = [t.id for t in self.tok.model.tokenize(raw if bare else chr(self.byte_marks[32]) + raw)]
            else:
                rest.append(i)
        # other words go to the library many at a time, a line each: a newline before a space is a token by itself
        lines = [i for i in rest if pieces[i] and pieces[i][0] != BARE and not any(x in pieces[i] for x in self.special)]
        for k in range(0, len(lines), 4000):
            part = lines[k : k + 4000]
            ids = np.array(self._whole(["\n " + "\n ".join(pieces[i] for i in part)])[0], dtype=np.int64)
            cuts = np.flatnonzero(ids == self.newline[0])
            if len(cuts) == len(part):
                for i, got in zip(part, np.split(ids, cuts[1:]), strict=True):
                    out[i] = got[1:].tolist()
        rest = [i for i in rest if out[i] is None]
        for i, got in zip(rest, self._whole([pieces[i][1:] if pieces[i][:1] == BARE else " " + pieces[i] for i in rest]), strict=True):
            out[i] = got
        return out

    def _keep(self, pieces: list[str], ids: list[list[int]]) -> None:
        n, sizes = len(self.at), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        end = n + len(ids)
        if end > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(end, dtype=np.int64)]) for x in (self.start, self.length))
        total = int(sizes.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.filled + total, dtype="<u4")])
        self.length[n:end] = sizes
        self.start[n:end] = self.filled + np.cumsum(sizes) - sizes
        self.pool[self.filled : self.filled + total] = np.fromiter((x for i in ids for x in i), dtype="<u4", count=total)
        self.filled += total
        self.at.update(zip(pieces, range(n, end), strict=True))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Ends of each text's pieces, and the pieces: after BARE as they are, others with a space before them."""
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for x in self.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, x))
        if not pc.any(uneven).as_py():
            cut = self._even(texts)
            return cut.offsets.to_numpy()[1:], cut.flatten()
        even = iter(self._even(texts.filter(pc.invert(uneven))).to_pylist())
        lists = [self._odd(t) if odd else next(even) for t, odd in zip(texts.to_pylist(), uneven.to_pylist(), strict=True)]
        return np.cumsum([len(x) for x in lists]), pa.array([p for x in lists for p in x], pa.large_string())

    def _even(self, texts: pa.Array) -> pa.Array:
        cut = pc.replace_substring_regex(texts, _STOP, _STOPPED)
        cut = pc.replace_substring(cut, "\n", f" {BARE}\n {BARE}")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BARE, pa.large_string()), cut, pa.scalar("", pa.large_string())), " ")

    def _odd(self, text: str) -> list[str]:
        if _FOREIGN.search(text) or any(x in text for x in self.special):
            return [BARE + text]
        return [BARE + x for x in _CUT.findall(text)]

    def encode_array(self, texts: pa.Array, tail: bytes = b"") -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, then `tail`; null and empty texts have none."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            return [np.array(x, dtype="<u4").tobytes() + tail for x in self._whole(filled.to_pylist())]
        if not len(filled):
            return []
        ends, pieces = self._pieces(filled)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.at) > STORE:
            self._empty()
        place = list(map(self.at.get, names))
        new = [i for i, at in enumerate(place) if at is None]
        new.sort(key=lambda i: len(names[i]) > KEPT)  # stable
        n, mark = len(self.at), self.filled
        added = [names[i] for i in new]
        self._keep(added, self._ids(added))
        for k, i in enumerate(new):
            place[i] = n + k
        rows = np.array(place, dtype=np.int64)[coded.indices.to_numpy()]
        size, first = self.length[rows], self.start[rows]
        after = np.cumsum(size)
        ids = self.pool[np.repeat(first - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        while added and len(added[-1]) > KEPT:  # whole texts and the like are not worth keeping
            del self.at[added.pop()]
        self.filled = mark if not added else int(self.start[n + len(added) - 1] + self.length[n + len(added) - 1])
        bound = 4 * np.concatenate([[0], np.concatenate([[0], after])[ends]])
        raw = ids.tobytes()
        return [raw[a:b] + tail for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- the coding: for every number 2 control bits, in bytes of their own, say in how many bytes (1 to 4) it lies

#: Fixed by the format, computed: for each control byte the lengths of its four numbers, and of all of them.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers under 2^32; a last control byte may be partly unused (zero bits)."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-len(v) % 4 + len(v), dtype=np.uint8)
    padded[: len(v)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers: lengths by table lookup of whole control bytes, then one gather a byte position."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(n, dtype="<u4")
    for j in range(4):
        there = np.flatnonzero(size > j)
        if len(there):
            out[there] |= raw[start[there] + j].astype("<u4") << np.uint32(8 * j)
    return out


#: Schemas; {} is the type that doc_id has.
RAW = "doc_id {}, ids binary"
CODED = "doc_id {}, n_tokens int, control binary, data binary"
BLOCK = "part int, block int, doc_ids array<{}>, n_tokens array<int>, control binary, data binary"
DECODED = "part int, block int, place int, doc_id {}, n_tokens long, ids_crc32 long"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString().removeprefix("array<").removesuffix(">")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least GATHER bytes, as what a batch costs grows with its distinct words."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, the end id last) of every row of docs(doc_id, _text)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _gathered(batches):
            ids = enc.encode_array(b.column(1), tail)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "_text").mapInArrow(run, RAW.format(_kind(docs, "doc_id")))


def _counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    """Uses of each id over all rows: one row of `vocabulary` counts a task, added up by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u4")
            total += np.bincount(ids, minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most `vocabulary` rows
    out = np.zeros(vocabulary, dtype=np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def _coder(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, control, data = [], [], []
            for ids in b.column(1).to_pylist():
                c, d = pack(rank[np.frombuffer(ids, dtype="<u4")])
                n.append(len(ids) // 4)
                control.append(c)
                data.append(d)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["doc_id", "n_tokens", "control", "data"])

    return run


def _blocks(block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        kind = None

        def out() -> pa.RecordBatch:
            d, n, c, x = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([d], pa.list_(kind)), pa.array([n], pa.list_(pa.int32())),
                pa.array([b"".join(c)], pa.binary()), pa.array([b"".join(x)], pa.binary())], names=["part", "block", "doc_ids", "n_tokens", "control", "data"])

        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + row[1] > block_ids:
                    yield out()
                    block, held, size = block + 1, [], 0
                held.append(row)
                size += row[1]
        if held:
            yield out()

    return run


def _decoder(ids_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, docs, counts, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, crc, c0, d0 = len(docs), [], 0, 0
                table = np.frombuffer(control, dtype=np.uint8)
                for k in counts:
                    c1 = c0 + -(-k // 4)
                    d1 = d0 + int(LENGTHS[table[c0:c1]].reshape(-1)[:k].sum())
                    ranks = unpack(control[c0:c1], data[d0:d1], k)
                    crc.append(zlib.crc32(ids_of[ranks].astype("<u4").tobytes()))
                    c0, d0 = c1, d1
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(docs, b.schema.field("doc_ids").type.value_type),
                    pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    return run


class TokenFiles:
    """Written token files: Parquet rows of blocks, in ascending doc_id order (nulls first), and the ids by rank."""

    def __init__(self, files: DataFrame, ids_of: np.ndarray, scratch: Scratch):
        self.files, self.ids_of, self.scratch = files, ids_of, scratch

    def ids(self) -> DataFrame:
        """doc_id and ids array<int> of every document, read back."""
        ids_of = self.ids_of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for docs, counts, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    c0, d0, out = 0, 0, []
                    for k in counts:
                        c1 = c0 + -(-k // 4)
                        d1 = d0 + int(LENGTHS[np.frombuffer(control[c0:c1], dtype=np.uint8)].reshape(-1)[:k].sum())
                        out.append(ids_of[unpack(control[c0:c1], data[d0:d1], k)].astype(np.int32))
                        c0, d0 = c1, d1
                    yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type.value_type), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return self.files.select("doc_ids", "n_tokens", "control", "data").mapInArrow(run, f"doc_id {_kind(self.files, 'doc_ids')}, ids array<int>")

    def digest(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
        got = self.scratch.write(self.files.mapInArrow(_decoder(self.ids_of), DECODED.format(_kind(self.files, "doc_ids"))), "decoded")
        # starts of blocks: a row a block, in two steps, so that no task gets the blocks of the whole corpus
        blocks = got.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
        parts = blocks.groupBy("part").agg(F.sum("n").alias("m")).selectExpr("part", "sum(m) over (order by part) - m as before")
        starts = blocks.join(F.broadcast(parts), "part").selectExpr(
            "part", "block", "before + sum(n) over (partition by part order by block) - n as before")
        return got.join(starts, ["part", "block"]).selectExpr(
            "doc_id", "before + sum(n_tokens) over (partition by part, block order by place) - n_tokens as start", "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, path: str, end: int = END, vocabulary: int | None = None, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Encodes docs(doc_id, text) and writes the token files.

    Each row's ids are those of its whole text with `end` after them; null and empty texts have `end` alone.
    Ids are ranked by their use over all rows (more used first, then the smaller id), so frequent ids take one
    byte. doc_id may be of any type that sorts. Rows with equal or null doc_id keep all their rows, in any order among themselves. An empty table
    gives files without blocks. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    if vocabulary is None:
        vocabulary = encoder(path).tok.get_vocab_size()
    raw = scratch.write(tokenised(docs.select("doc_id", F.col("text").alias("_text")), path, end), "raw", compression="zstd")
    counts = _counts(raw, vocabulary)
    ids_of = np.lexsort((np.arange(vocabulary), -counts)).astype("<u4")
    rank = np.empty(vocabulary, dtype="<u4")
    rank[ids_of] = np.arange(vocabulary, dtype="<u4")
    # written, as a range shuffle reads its input twice
    coded = scratch.write(raw.mapInArrow(_coder(rank), CODED.format(_kind(raw, "doc_id"))), "coded", compression="uncompressed")
    scratch.drop("raw")
    coded = coded.withColumn("_tie", F.monotonically_increasing_id())
    ordered = coded.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie")
    files = scratch.write(ordered.mapInArrow(_blocks(block_ids), BLOCK.format(_kind(raw, "doc_id"))), "files", compression="uncompressed")
    scratch.drop("coded")
    return TokenFiles(files, ids_of, scratch)
