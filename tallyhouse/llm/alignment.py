"""Alignment of two tokenizers over the same texts, by their common token ends.

1. Both tokenizers encode a space and the text; a token's bytes are those its entry stands
   for, so that both lists of token ends measure the same bytes.
2. The shorter list of ends drives the search in the longer one: an end starts where an
   earlier one was found, doubles its step until it is passed, and halves what is left. Many
   ends leap at once, first those far apart, then those between.
3. Common ends cut the tokens into groups. The ranks of a token's two ends in the other list
   give the range of tokens that it overlaps: its links. A text of any length is taken in
   stretches that end at a common end, so no link is cut.
4. A chunk of documents (``CHUNK`` bytes of text) becomes the list of its distinct id pairs
   with their numbers, and per document the places in that list. Only a chunk's list is
   shuffled, added up over all chunks, and sent back to it: what a pair that every document
   holds costs is one row a chunk. The best count per id of the second tokenizer has a row per
   id of its vocabulary at most, the one thing that is broadcast.

Special tokens written in a text are plain text. A text that is null or empty, or whose
tokens of either side do not spell out the space and the text, has no tokens: zeros and an
empty digest. Repeated rows and ids are aligned each for itself, and each adds its links to
the counts. An empty table gives no rows. Only the columns named are read, so others may have
any name.

``PieceEncoder`` encodes by a sentencepiece file with a cache. Bytes between which no entry of
the vocabulary continues can never share a token, so pieces are cut there and encoded once; a
model that changes texts before it encodes, or that has no byte for a line end, goes without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.idfiles import pack_values, unpack_values
from tallyhouse.llm.text import BLOCK, Spans, bytes_and_offsets
from tallyhouse.llm.tokens import Encoder
from tallyhouse.session import materialize

#: Bytes of text whose pairs make one list.
CHUNK = 8 << 20
#: Tokens of one text that are aligned at once.
STRETCH = 1 << 17
#: Pieces that a worker keeps the second tokenizer's ids of; the cache starts anew beyond.
PIECES = 250_000
#: Every end of a level starts from one of the level before, this many times sparser.
FAN = 4
_SPACE = "▁"


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others for the signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Entries:
    """The bytes of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self._start = np.cumsum(self.size) - self.size
        self._data = np.frombuffer(b"".join(entries) or b"\0", dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self._data[np.repeat(self._start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class PlainEncoder(Encoder):
    """Ids by a byte-level file of the tokenizers library; special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._tokenizer.encode_special_tokens = True
        signs, names = byte_signs(), self._tokenizer.get_vocab()
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            entries[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
        self.entries = Entries(entries)


class PieceEncoder:
    """Ids of a sentencepiece file for texts that start with the space the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        entries = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
        self.entries = Entries(entries)
        self._meet = np.zeros((256, 256), dtype=bool)  # bytes that stand side by side in an entry
        for i, e in enumerate(entries):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                raw = np.frombuffer(e, dtype=np.uint8)
                self._meet[raw[:-1], raw[1:]] = True
        self._meet[:, 0x80:0xC0] = True  # the inside of a sign
        line = [i for i in range(len(names)) if entries[i] == b"\n"]
        self._line = line[0] if len(line) == 1 and model.is_byte(line[0]) else -1
        probe = " ﬁ  Ǻ x\t "
        same = model.normalize(probe).replace(_SPACE, " ") in (probe, " " + probe)
        self._apart = ~self._meet.ravel()
        self._cuts = same and self._line >= 0 and not self._meet[:, 10].any() and not self._meet[10, :0x80].any()
        self._reset()

    def _reset(self) -> None:
        """The ids of all known pieces in one array, and by piece where they start and how many they are."""
        self._known: dict[int, int] = {}
        self._ids, self._used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _keep(self, keys: list[int], ids: list[np.ndarray]) -> None:
        end = self._used + sum(map(len, ids))
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), end), np.uint32)])
        for key, own in zip(keys, ids, strict=True):
            self._ids[self._used : self._used + len(own)] = own
            self._known[key] = self._used << 32 | len(own)
            self._used += len(own)

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        """Many pieces to a call, with line ends between them."""
        for k in range(0, len(pieces), 256):
            part = pieces[k : k + 256]
            ids = np.array(self._model.encode("\n" + "\n".join(part)), dtype=np.uint32)
            ends = np.append(np.flatnonzero(ids == self._line), len(ids))
            self._keep(keys[k : k + 256], [ids[a:b] for a, b in zip(ends[:-1] + 1, ends[1:], strict=True)])

    def _block(self, data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block and how many each of its values has; values: their starts."""
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = self._apart.take(data[:-1].astype(np.uint16) << 8 | data[1:])
        cut[values] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        line = data[starts] == 10
        keys, first, of = np.unique(Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        if len(self._known) + len(keys) > PIECES:
            self._reset()
        names, raw, known = keys.tolist(), data.tobytes(), self._known
        new = [i for i, key in enumerate(names) if key not in known]
        lines = [names[i] for i in new if line[first[i]]]
        self._keep(lines, [np.array([self._line], dtype=np.uint32)] * len(lines))
        new = [i for i in new if not line[first[i]]]
        self._learn([names[i] for i in new], [raw[starts[first[i]] : ends[first[i]]].decode() for i in new])
        found = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[of]
        begin, size = found >> 32, found & 0xFFFFFFFF
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self._ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, np.append(values, len(data)))])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text; each starts with a space, which the model itself adds."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._cuts and _SPACE.encode() not in t and len(t) <= BLOCK]
        for i in set(range(len(texts))) - set(plain):
            out[i] = self._long(texts[i])
        k = 0
        while k < len(plain):
            size, first = 0, k
            while k < len(plain) and (k == first or size + len(texts[plain[k]]) <= BLOCK):
                size += len(texts[plain[k]])
                k += 1
            take = plain[first:k]
            sizes = np.array([len(texts[i]) for i in take])
            ids, counts = self._block(np.frombuffer(b"".join(texts[i] for i in take), dtype=np.uint8), np.cumsum(sizes) - sizes)
            for i, part in zip(take, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """A text above the size of a block, cut where no entry continues; others go to the model whole."""
        if not self._cuts or _SPACE.encode() in text:
            return np.array(self._model.encode(text[1:].decode()), dtype=np.uint32)
        data, at, parts = np.frombuffer(text, dtype=np.uint8), 0, []
        while at < len(data):
            end = at + BLOCK
            while end < len(data):
                near = data[end - 1 : end + BLOCK]
                found = np.flatnonzero(~self._meet[near[:-1], near[1:]])
                if len(found):
                    end += int(found[0])
                    break
                end += BLOCK
            parts.append(self._block(data[at:end], np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(parts)


def _leap(values: np.ndarray, longer: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of ``longer``, whose last is above all values, lie below each of ``values``,
    at least ``low``: steps double until they reach the value, then the last step is halved."""
    out, at, step = low.copy(), np.arange(len(values), dtype=np.int32), 1
    while len(at):
        less = longer.take(low + (step - 1), mode="clip") < values
        stop = ~less
        found, value, half = low[stop], values[stop], step >> 1
        while half:
            found += half * (longer.take(found + (half - 1), mode="clip") < value)
            half >>= 1
        out[at[stop]] = found
        at, low, values = at[less], low[less] + step, values[less]
        step *= 2
    return out


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """How many of the ascending ``longer`` lie below each of the ascending ``shorter``."""
    rank = np.zeros(len(shorter), dtype=np.int32)
    top = max(int(shorter[-1]) if len(shorter) else 0, int(longer[-1]) if len(longer) else 0) + 1
    kind = np.int32 if top < 2**31 else np.int64
    shorter, longer = shorter.astype(kind), np.append(longer, top).astype(kind)
    stride = 1
    while stride * FAN < len(shorter):
        stride *= FAN
    start = np.zeros(len(range(0, len(shorter), stride)), dtype=np.int32)
    while True:
        rank[::stride] = _leap(shorter[::stride], longer, start)
        if stride == 1:
            return rank
        stride //= FAN
        start = np.repeat(rank[:: stride * FAN], FAN)[: len(range(0, len(shorter), stride))]


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of token ends with the same last end: the tokens of each that end a
    group, and the linked tokens of each, pair by pair."""
    turned = len(a_ends) > len(b_ends)
    drive, other = (b_ends, a_ends) if turned else (a_ends, b_ends)
    rank = gallop(drive, other)
    hit = other[np.minimum(rank, len(other) - 1)] == drive
    first = np.concatenate((np.zeros(1, np.int32), (rank + hit)[:-1]))
    count = rank - first + 1
    ends = np.cumsum(count)
    own = np.repeat(np.arange(len(drive)), count)
    met = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
    cuts = np.flatnonzero(hit)
    if turned:
        return rank[cuts], cuts, met, own
    return cuts, rank[cuts], own, met


class Writer:
    """The decimal text of groups."""

    _SIGNS = ",|;"

    def __init__(self, ids: int):
        texts = [f"{i}{sign}".encode() for i in range(ids) for sign in self._SIGNS]
        width = -(-max(map(len, texts), default=1) // 8)
        self._size = np.array([len(t) for t in texts], dtype=np.int32)
        raw = np.frombuffer(b"".join(t.ljust(8 * width, b"\0") for t in texts), dtype=np.uint64)
        self._text = raw.reshape(-1, width)

    def text(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``a1,a2|b1;...`` with a separator behind every id, and where each ``b`` group ends."""
        row = np.zeros(len(a) + len(b), dtype=np.int64)
        before = np.concatenate(([0], b_cuts[:-1] + 1))
        at_a = np.arange(len(a)) + np.repeat(before, np.diff(a_cuts, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(a_cuts + 1, np.diff(b_cuts, prepend=-1))
        row[at_a], row[at_b] = a, b
        row *= len(self._SIGNS)
        last = at_b[b_cuts]
        row[at_a[a_cuts]] += 1
        row[last] += 2
        wide = self._text.take(row, axis=0).view(np.uint8).ravel()
        return wide[wide != 0], np.cumsum(self._size.take(row))[last]


class Aligner:
    """One per Python worker and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainEncoder(a_path), PieceEncoder(b_path)
        self.a_ids, self.b_ids = len(self.a.entries.size), len(self.b.entries.size)
        self._writer = Writer(max(self.a_ids, self.b_ids))

    def encoded(self, column) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of every text; None for a text without tokens."""
        column = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, offsets = bytes_and_offsets(column)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(column))]
        some = [i for i, t in enumerate(texts) if len(t) > 1]
        out: list = [None] * len(texts)
        b_side = self.b.encode([texts[i] for i in some])
        a_side = self.a.encode(column.take(pa.array(some, pa.int64())))
        for i, a, b in zip(some, a_side, b_side, strict=True):
            if all(
                int(e.size[x].sum()) == len(texts[i]) and (e.joined(x) == data[offsets[i] : offsets[i + 1]]).all()
                for e, x in ((self.a.entries, a), (self.b.entries, b))
            ):
                out[i] = (a, b)
        return out

    def stretches(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """Documents in runs of some ``STRETCH`` tokens, or parts of a long one up to a common
        end: number of the first document, whether it ends there, ids and ends of both sides,
        and where each document ends."""
        k = 0
        while k < len(docs):
            size, first = 0, k
            while k < len(docs) and (k == first or size + len(docs[k][0]) <= STRETCH):
                size += len(docs[k][0])
                k += 1
            a, b = (np.concatenate([d[s] for d in docs[first:k]]) for s in (0, 1))
            a_ends, b_ends = np.cumsum(self.a.entries.size[a]), np.cumsum(self.b.entries.size[b])
            if k - first > 1 or len(a) <= STRETCH:
                yield first, True, a, b, a_ends, b_ends, a_ends[np.cumsum([len(d[0]) for d in docs[first:k]]) - 1]
                continue
            done, reach, at, bt = 0, STRETCH, 0, 0
            while at < len(a):
                end = min(at + reach, len(a))
                stop = int(np.searchsorted(b_ends, a_ends[end - 1], side="right"))
                cuts = np.flatnonzero(np.isin(a_ends[at:end], b_ends[bt:stop]))
                if not len(cuts):
                    reach *= 2
                    continue
                end = at + int(cuts[-1]) + 1
                stop = int(np.searchsorted(b_ends, a_ends[end - 1], side="right"))
                yield first, end == len(a), a[at:end], b[bt:stop], a_ends[at:end] - done, b_ends[bt:stop] - done, a_ends[end - 1 : end] - done
                done, at, bt, reach = int(a_ends[end - 1]), end, stop, STRETCH

    def documents(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[list], list[tuple]]:
        """Per document [n_a, n_b, n_groups, n_links, digest], and its pairs: (documents, codes,
        numbers) per stretch, sorted, each document in one of them."""
        rows = [[len(a), len(b), 0, 0, hashlib.sha256()] for a, b in docs]
        pairs, space = [], self.a_ids * self.b_ids
        kind, cut = np.uint32 if space <= 1 << 32 else np.int64, []
        for first, ended, a, b, a_ends, b_ends, doc_ends in self.stretches(docs):
            a_cuts, b_cuts, own, met = aligned(a_ends, b_ends)
            text, ends = self._writer.text(a, b, a_cuts, b_cuts)
            cut_doc = np.searchsorted(doc_ends, a_ends[a_cuts])
            link_doc = np.searchsorted(doc_ends, a_ends)[own]
            n_groups, n_links = (np.bincount(x, minlength=len(doc_ends)).tolist() for x in (cut_doc, link_doc))
            stops = ends[np.cumsum(n_groups) - 1].tolist()
            raw, at = memoryview(text), 0
            for k, stop in enumerate(stops):
                row = rows[first + k]
                row[2] += n_groups[k]
                row[3] += n_links[k]
                row[4].update(raw[at : stop - 1 if ended else stop])  # no separator behind the last group
                at = stop
            codes = a[own].astype(np.int64) * self.b_ids + b[met]
            keys = np.sort(link_doc * space + codes)
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            part = ((first + keys[start] // space).astype(np.int32), (keys[start] % space).astype(kind), np.diff(start, append=len(keys)).astype(np.int32))
            if ended and not cut:
                pairs.append(part)
                continue
            cut.append(part)  # parts of one long document repeat its pairs
            if ended:
                codes, place = np.unique(np.concatenate([c for _, c, _ in cut]), return_inverse=True)
                number = np.bincount(place, weights=np.concatenate([n for _, _, n in cut]), minlength=len(codes)).astype(np.int64)
                pairs.append((np.full(len(codes), first, np.int32), codes, number))
                cut = []
        return rows, pairs


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def groups(a_path: str, b_path: str, text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of both sides."""
    own = aligner(a_path, b_path)
    found = own.encoded(pa.array([text], pa.large_string()))[0]
    if found is None:
        return []
    a, b = found
    a_cuts, b_cuts, _, _ = aligned(np.cumsum(own.a.entries.size[a]), np.cumsum(own.b.entries.size[b]))
    return [(x.tolist(), y.tolist()) for x, y in zip(np.split(a, a_cuts[:-1] + 1), np.split(b, b_cuts[:-1] + 1), strict=True)]


_BINARY = ("places", "place_bytes", "repeats", "repeat_bytes")


def _coded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per document with its places in its chunk's list of pairs; the first row of a chunk holds the list."""
    kind = docs.schema[id_col].dataType
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([
        ("chunk", pa.int64()), ("doc_id", to_arrow_type(kind)), *((n, pa.int64()) for n in numbers), ("groups_sha256", pa.string()),
        ("n_pairs", pa.int64()), *((n, pa.binary()) for n in _BINARY), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ])
    ddl = f"chunk long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, places binary, place_bytes binary, repeats binary, repeat_bytes binary, pairs array<long>, counts array<long>"

    def written(chunk: int, keys: list, rows: list[list], parts: list[tuple]) -> pa.RecordBatch:
        of, codes, number = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        parts.clear()  # they are not needed beside their join
        edges = np.searchsorted(of, np.arange(len(keys) + 1))
        pairs, place = np.unique(codes, return_inverse=True)
        del of, codes
        counts = np.bincount(place, weights=number, minlength=len(pairs)).astype(np.int64)
        pairs = pairs.astype(np.int64)
        coded = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            again = number[a:b] > 1
            coded.append((*pack_values(np.diff(place[a:b], prepend=0) * 2 + again), *pack_values(number[a:b][again].astype(np.int64))))
        lists = [(pairs, counts), *[(None, None)] * (len(keys) - 1)]
        columns = [[chunk] * len(keys), keys, *zip(*(r[:4] for r in rows), strict=True), [r[4] if isinstance(r[4], str) else r[4].hexdigest() for r in rows]]
        columns += [np.diff(edges), *zip(*coded, strict=True), *zip(*lists, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        chunk, keys, rows, parts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            _, offsets = bytes_and_offsets(batch.column(1))
            at = 0
            while at < len(batch):
                # a block's worth of texts at a time, one at least
                end = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1, at + 1)
                if keys and size + int(offsets[end] - offsets[at]) > CHUNK:
                    yield written(chunk, keys, rows, parts)
                    chunk, keys, rows, parts, size = chunk + 1, [], [], [], 0
                found = own.encoded(batch.column(1).slice(at, end - at))
                some = np.array([i for i, f in enumerate(found) if f is not None], dtype=np.int64)
                done, pairs = own.documents([found[i] for i in some])
                fresh = [[0, 0, 0, 0, ""] for _ in found]
                for i, row in zip(some, done, strict=True):
                    fresh[i] = row
                parts += [((len(keys) + some[of]).astype(np.int32), codes, number) for of, codes, number in pairs]
                keys += batch.column(0).slice(at, end - at).to_pylist()
                rows += fresh
                size += int(offsets[end] - offsets[at])
                at = end
        if keys:
            yield written(chunk, keys, rows, parts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most
    frequent of its second id, ties included), count_sum (over links, how often the corpus
    holds the pair), groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    b_ids = SentencePieceProcessor(model_file=b_path).get_piece_size()
    coded = materialize(spark, _coded(docs, a_path, b_path, id_col, text_col), "aligned")
    lists = coded.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "at"))
    lists = lists.select("chunk", "place", F.col("at.pairs").alias("pair"), F.col("at.counts").alias("n"))
    total = materialize(spark, lists.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # one row per id of the second vocabulary at most
    top = total.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("n").alias("most"))
    marked = total.join(F.broadcast(top), F.col("pair") % b_ids == F.col("b")).select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("best"))
    found = lists.select("chunk", "place", "pair").join(marked, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = docs.schema[id_col].dataType
    schema = pa.schema([
        ("doc_id", to_arrow_type(kind)), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()),
    ])

    def summed(rows: pa.Table, marks: pa.Table) -> pa.Table:
        place = marks.column("place").to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = marks.column("count").to_numpy(), marks.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for n, *streams in zip(*(rows.column(c).to_pylist() for c in ("n_pairs", *_BINARY)), strict=True):
            coded = unpack_values(streams[0], streams[1], n).astype(np.int64)
            own, number = np.cumsum(coded >> 1), np.ones(n, dtype=np.int64)
            again = np.flatnonzero(coded & 1)
            number[again] = unpack_values(streams[2], streams[3], len(again))
            sums.append(int((count[own] * number).sum()))
            bests.append(int((best[own] * number).sum()))
        parts = {c: rows.column(c) for c in kept} | {"count_sum": pa.array(sums, pa.int64()), "n_best": pa.array(bests, pa.int64())}
        return pa.table([parts[f.name].cast(f.type) for f in schema], schema=schema)

    each = coded.select("chunk", *kept, "n_pairs", *_BINARY).groupBy("chunk")
    ddl = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return each.cogroup(found.groupBy("of")).applyInArrow(summed, ddl)
