"""Encoding and decoding with a SentencePiece BPE model, keeping original byte spans.

Normalisation follows the compiled character map: at each place the longest key of the map
is replaced by its value, and every normalised character records where its source starts
and ends. Merging works on chunks that no piece of the vocabulary can cross; distinct
chunks are merged once and remembered. Pieces are projected back to original byte spans.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inductra.llm.common import list_array, ragged, row_slices, tidy
from inductra.llm.merging import Rules, merge

SPACE = "▁"  # stands for a blank inside pieces; a fixed value of the format

#: Distinct chunks whose pieces one Python worker remembers.
REMEMBERED = 400_000

#: Longer chunks are merged one by one with a heap, shorter ones side by side in arrays.
SHORT = 64

#: Bytes of text encoded at once, whatever the size of the Arrow batch it came in.
SLICE_BYTES = 1 << 20

ENCODED = "ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, and the texts it points to.

    Format (public): a little-endian length, that many bytes of 32-bit trie units, then
    zero-terminated replacement texts.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.remembered: dict[bytes, tuple[int, str] | None] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & ((1 << 31) - 1))
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end].decode("utf-8")

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Model:
    """A BPE model file: pieces, scores, character map and its switches."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        if spec.trainer_spec.treat_whitespace_as_suffix or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("suffix blanks and denormalisers are not supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.texts = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.scores = [p.score for p in spec.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_surface = spec.trainer_spec.unk_surface
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        options = spec.normalizer_spec
        self.map = CharacterMap(options.precompiled_charsmap)
        self.prefix = options.add_dummy_prefix
        self.squeeze = options.remove_extra_whitespaces
        self.escape = options.escape_whitespaces
        self.chunks = self._splitter()
        self.piece_chars = np.array([len(p) for p in self.texts], np.int64)
        self.rules = self._rules()
        self.forget()

    def _splitter(self):
        """Cuts a normalised text where no piece can cross.

        Characters that stand side by side in some piece belong together, and so do theirs; a
        place between two characters that do not belong together is never inside a piece.
        Blanks stay with what follows them.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return lambda text: [text] if text else []
        group = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = c = group[group[c]]
            return c

        for piece in self.ids:
            body = piece.lstrip(SPACE)
            for a, b in zip(body, body[1:]):
                group[root(a)] = root(b)
        together: dict[str, list[str]] = {}
        for c in group:
            together.setdefault(root(c), []).append(c)
        sets = ["".join(map(re.escape, sorted(cs))) for cs in together.values()]
        kinds = "|".join([*(f"[{cs}]+" for cs in sorted(sets, key=len, reverse=True)), f"[^{SPACE}{''.join(sets)}]+"])
        return re.compile(f"{SPACE}*(?:{kinds})|{SPACE}+", re.S).findall

    def _rules(self) -> Rules:
        """Every way to make a piece of two neighbours; characters without id count from ``len(texts)`` on."""
        ids, many = self.ids, len(self.texts)
        rank = {s: i for i, s in enumerate(sorted({-self.scores[i] for i in ids.values()}))}

        def symbol(part: str) -> int | None:
            return ids.get(part, many + ord(part) if len(part) == 1 else None)

        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank[-self.scores[i]], i)
        return Rules(pairs)

    def forget(self) -> None:
        """Start an empty chunk table: number of each chunk, and its pieces in flat arrays.

        ``odd`` has the decoded text of chunks that do not decode to themselves.
        """
        self.number: dict[str, int] = {}
        self.odd: dict[str, str] = {}
        self.flat = np.zeros(0, np.int32)
        self.chars = np.zeros(0, np.int64)  # characters of the chunk up to the end of a piece
        self.sizes = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    # Normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its characters the original byte range.

        A character that normalisation adds in front has the empty range at its place.
        """
        out, start, end = self._mapped(text)
        blank = " " if not self.escape else SPACE
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            out = "".join(out[i] for i in keep)
            start, end = start[keep], end[keep]
        if not out:
            return "", start[:0], end[:0]
        if self.escape:
            out = out.replace(" ", SPACE)
        if self.prefix:
            out = blank + out
            start = np.concatenate([start[:1], start])
            end = np.concatenate([start[:1], end])
        return out, start, end

    def _mapped(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        if not self.map.units:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
            end = np.cumsum(size, dtype=np.int32)
            return text, end - size, end
        raw = text.encode("utf-8", "surrogatepass")
        parts, start, end, at = [], [], [], 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found is None:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = raw[at : at + size].decode("utf-8", "surrogatepass")
            else:
                size, piece = found
            parts.append(piece)
            start.extend([at] * len(piece))
            end.extend([at + size] * len(piece))
            at += size
        return "".join(parts), np.array(start, np.int32), np.array(end, np.int32)

    # Merging

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best-scored neighbours first, leftmost among equals."""
        parts: list[str | None] = list(chunk)
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        ids, scores, heap = self.ids, self.scores, []

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]
            number = ids.get(joined)
            if number is not None:
                heapq.heappush(heap, (-scores[number], left, right, joined))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or parts[left] + parts[right] != joined:
                continue
            if after[left] != right:
                continue
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None]

    def merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chunks, and how many each has; from ``len(texts)`` on characters without id."""
        ids, many = self.ids, len(self.texts)
        short = [c for c in chunks if len(c) <= SHORT]
        joined = "".join(short)
        points, back = np.unique(
            np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True
        )
        symbols = np.array([ids.get(chr(p), many + p) for p in points.tolist()], np.int64)[back]
        flat, left = merge(self.rules, symbols, np.fromiter(map(len, short), np.int64, len(short)), leftmost=True)
        if len(short) == len(chunks):
            return flat, left
        runs, at = [], 0
        ends = np.cumsum(left)
        for chunk in chunks:
            if len(chunk) <= SHORT:
                runs.append(flat[ends[at] - left[at] : ends[at]])
                at += 1
            else:
                parts = self.merge(chunk)
                runs.append(np.array([ids[p] if p in ids else many + ord(p) for p in parts], np.int64))
        return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))

    def add(self, chunks: list[str]) -> None:
        """Add unseen chunks to the chunk table.

        A character outside the vocabulary becomes its bytes, all ending where it ends, or
        the unknown piece, one for a run of such characters.
        """
        if not chunks:
            return
        many = len(self.texts)
        symbols, left = self.merged(chunks)
        unknown = symbols >= many
        ends = np.cumsum(np.where(unknown, 1, self.piece_chars[np.where(unknown, 0, symbols)]))
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends -= np.repeat(np.cumsum(lengths) - lengths, left)
        if unknown.any():
            owner = np.repeat(np.arange(len(chunks)), left)
            if self.bytes:
                raw = [chr(p).encode("utf-8", "surrogatepass") for p in (symbols[unknown] - many).tolist()]
                times = np.ones(len(symbols), np.int64)
                times[unknown] = list(map(len, raw))
                ids = np.repeat(np.where(unknown, 0, symbols), times)
                ids[np.repeat(unknown, times)] = [self.bytes[b] for r in raw for b in r]
            else:
                follows = unknown & np.concatenate([unknown[1:] & (owner[1:] == owner[:-1]), [False]])
                times = (~follows).astype(np.int64)
                ids = np.repeat(np.where(unknown, self.unknown, symbols), times)
            ends = np.repeat(ends, times)
            left = np.add.reduceat(times, np.cumsum(left) - left)
            starts = np.cumsum(left) - left
            for i in np.unique(owner[unknown]).tolist():
                text = self._inner(ids[starts[i] : starts[i] + left[i]].tolist())
                if text != chunks[i].replace(SPACE, " "):
                    self.odd[chunks[i]] = text
            symbols = ids
        for chunk in chunks:
            self.number[chunk] = len(self.number)
        self.flat = np.concatenate([self.flat, symbols.astype(np.int32)])
        self.chars = np.concatenate([self.chars, ends])
        self.sizes = np.concatenate([self.sizes, left])
        self.lengths = np.concatenate([self.lengths, lengths])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks restored, runs of byte pieces read as UTF-8."""
        out: list[str] = []
        pending = bytearray()
        bos, seen, first = True, False, True
        for i in [*ids, None]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                first = False
                continue
            if pending:
                out.append(decode_bytes(bytes(pending)))
                pending.clear()
            if i is None:
                break
            if seen or (not first and any(out)):
                bos = False
            first = False
            if i in self.control:
                seen = False
                continue
            if i == self.unknown:
                out.append(self.unknown_surface)
                seen = False
                continue
            piece = self.texts[i]
            seen = False
            if bos and (self.prefix or self.squeeze) and piece.startswith(SPACE):
                piece = piece[1:]
                seen = not self.squeeze
            out.append(piece.replace(SPACE, " "))
        return "".join(out)

    # Batches

    def _inner(self, ids: list[int]) -> str:
        """Decoded text of a chunk that is not the first of its text."""
        texts, out, pending = self.texts, [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(decode_bytes(bytes(pending)))
                pending.clear()
            out.append(self.unknown_surface if i == self.unknown else texts[i].replace(SPACE, " "))
        out.append(decode_bytes(bytes(pending)))
        return "".join(out)

    def encode(self, texts: list[str]) -> pa.StructArray:
        """Ids, original byte spans and decoded text of each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        coded, decoded, counts, froms, tos = [], [], [], [], []
        normal = [self.normalise(text) for text in texts]
        cut = [self.chunks(out) for out, _, _ in normal]
        self.add(list(set().union(*cut).difference(self.number)))
        sizes, lengths, flat, chars = self.sizes, self.lengths, self.flat, self.chars
        self.starts = starts = np.cumsum(sizes) - sizes
        for chunks in cut:
            numbers = list(map(self.number.__getitem__, chunks))
            coded.append(np.array(numbers, np.int64))
            decoded.append(self._decoded(numbers, chunks))
        ids = []
        for numbers, (_, start, end) in zip(coded, normal):
            at = ragged(starts[numbers], sizes[numbers])
            upto = chars[at] + np.repeat(np.cumsum(lengths[numbers]) - lengths[numbers], sizes[numbers])
            begin = np.concatenate([[0], upto[:-1]])[: len(upto)]
            ids.append(flat[at])
            froms.append(start[np.minimum(begin, upto - 1)])
            tos.append(end[upto - 1])
            counts.append(len(at))
        lists = [
            list_array(pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32()), np.array(counts, np.int64))
            for x in (ids, froms, tos)
        ]
        return pa.StructArray.from_arrays([*lists, pa.array(decoded, pa.string())], ["ids", "starts", "ends", "decoded"])

    def _decoded(self, numbers: list[int], chunks: list[str]) -> str:
        if not numbers:
            return ""
        if len(numbers) == 1:
            n = numbers[0]
            return self.decode(self.flat[self.starts[n] : self.starts[n] + self.sizes[n]].tolist())
        if self.odd:
            text = "".join(self.odd.get(c) or c.replace(SPACE, " ") for c in chunks)
        else:
            text = "".join(chunks).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def decode_bytes(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that fits nowhere."""
    out = []
    while raw:
        try:
            out.append(raw.decode("utf-8"))
            break
        except UnicodeDecodeError as error:
            out.append(raw[: error.start].decode("utf-8") + "�")
            raw = raw[error.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "encoded", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) and ``out``, a struct (ids, starts, ends, decoded).

    ``path`` names the model file. ``starts`` and ``ends`` are byte offsets into the original
    UTF-8 text. Null and empty texts have no ids and decode to the empty text. Row by row:
    repeated rows do not matter, and texts of any length are encoded whole. Other columns stay,
    but for one that is called ``out``.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    rows = df.select(F.col(text).alias("__text"), *kept)
    schema = StructType([*rows.schema.fields[1:], StructField(out, StructType.fromDDL(ENCODED))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in row_slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(start, end - start)
                found = model(path).encode([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], found], [*kept, out])
            tidy()
        model(path).forget()
        tidy()

    return rows.mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of ids; null stays null."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else model(path).decode(x) for x in lists.to_pylist()], pa.string())

    return decoded(ids)
