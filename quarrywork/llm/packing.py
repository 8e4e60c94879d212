"""Packing tokenized documents into as few sequences as possible.

Documents are cut only where one is longer than a sequence. Pieces are dealt at random into cells of bounded size; each
cell fills sequences by best fit and then improves them by local search: it moves a piece, or exchanges one for one or two for one,
between underfull sequences whenever that increases the sum of squared fills, which fills some and empties others, until nothing gains.
Sequences of different cells that are still underfull then meet in new cells, first the emptiest alone, then the emptier ones, then all, until none is emptied any more.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, schema, settle, ship, table

LENGTH, END = 4096, 1
#: Pieces in a cell, about; a cell is packed by one task at a time.
CELL = 8192
#: Underfull sequences of a cell, once sequences are dealt.
BINS = 512
#: Words a worker remembers with their ids.
KNOWN = 400_000

#: White space of the tokenizer's patterns, and characters whose lower case and normal form are their own letters' (Latin with Latin Extended-A).
_PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-ſ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds(dict):
    """word -> its ids as little-endian bytes. Words are independent of each other for a tokenizer that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.bytes = Tokenizer.from_file(path), _byte_letters()
        self.model, self.pieces = self.whole.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        if word.isascii() and word.isalpha():
            ids = self.piece(word.lower())
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.piece, _PIECE.findall(word.lower())))
        else:
            ids = self.direct(word)
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) > KNOWN:
                self.pieces.clear()
            letters = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.bytes)
            ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return ids

    def direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or not unicodedata.is_normalized("NFC", text):
            return self.direct(text)
        return b"".join([self[w] for w in text.split()])


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of docs(doc_id, text). Null text: empty, one piece with the end id alone."""
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def cut(batches):
        known = word_ids(path)
        for batch in parts(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = known.text(text or "") + tail
                for i, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else ([],) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema("doc_id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Longest first, each into the sequence with the least room that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        left, b = room.pop(at) if at < len(room) else (size, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > n:
            insort(room, (left - n, b))
    return bins


def _choices(members: list[int], n: list[int]) -> np.ndarray:
    """What a sequence can give: every piece and every two pieces, by distinct lengths. Rows: length, first piece, second piece or -1."""
    at: dict[int, list[int]] = {}
    for i in members:
        at.setdefault(n[i], []).append(i)
    length, piece = np.array(sorted(at), np.int64), np.array([at[x][0] for x in sorted(at)], np.int64)
    twice = [x for x in at if len(at[x]) > 1]
    x, y = np.triu_indices(len(length), 1)
    return np.concatenate([
        [length, piece, np.full(len(piece), -1)], [length[x] + length[y], piece[x], piece[y]],
        np.array([(2 * v, at[v][0], at[v][1]) for v in twice], np.int64).reshape(-1, 3).T], axis=1)


def improve(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Local search on all underfull bins: moves one or two pieces into a bin, or exchanges them for one of its own, from a bin that is no fuller, until no step gains.

    A step that takes `by` tokens from a bin of fill g to one of fill f adds 2 * by * (f - g + by) to the sum of squared fills. In each pass every bin, fullest
    first, takes the step that gains most, found among all bins' choices sorted by length; a bin takes part in one step a pass.
    """
    n = lengths.tolist()
    bins = {b: list(x) for b, x in enumerate(bins) if x}
    fill = np.zeros(max(bins, default=-1) + 1, np.int64)
    for b, members in bins.items():
        fill[b] = sum(n[i] for i in members)
    known: dict[int, np.ndarray] = {}
    while True:
        under = sorted((b for b in bins if fill[b] < size), key=lambda b: (-fill[b], b))
        for b in under:
            if b not in known:
                known[b] = _choices(bins[b], n)
        if not under:
            break
        length, first, second = np.concatenate([known[b] for b in under], axis=1)
        of = np.repeat(under, [known[b].shape[1] for b in under])
        order = np.argsort(length, kind="stable")
        length, first, second, of = length[order], first[order], second[order], of[order]
        touched = np.zeros(len(fill), bool)
        for a in under:
            if touched[a]:
                continue
            room, best, step = size - fill[a], 0, None
            for own in [0, *sorted({n[i] for i in bins[a]})]:
                low, high = np.searchsorted(length, (own, own + room), "right")
                if low == high:
                    continue
                b, by = of[low:high], length[low:high] - own
                gain = np.where((fill[b] <= fill[a]) & (b != a) & ~touched[b], 2 * by * (fill[a] - fill[b] + by), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, step = gain[k], (int(b[k]), low + k, own)
            if step:
                b, k, own = step
                come = [i for i in (int(first[k]), int(second[k])) if i >= 0]
                go = [next(i for i in bins[a] if n[i] == own)] if own else []
                bins[a] = [i for i in bins[a] if i not in go] + come
                bins[b] = [i for i in bins[b] if i not in come] + go
                fill[a] += (by := int(length[k]) - own)
                fill[b] -= by
                touched[a] = touched[b] = True
                known.pop(a), known.pop(b)
                if not bins[b]:
                    del bins[b]
        if not touched.any():
            break
    return [bins[b] for b in sorted(bins)]


def pack_cell(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit, then local search on all underfull sequences."""
    bins = best_fit(lengths, size)
    full = [int(lengths[b].sum()) == size for b in bins]
    return [b for b, x in zip(bins, full) if x] + improve([b for b, x in zip(bins, full) if not x], lengths, size)


def pack(parts: DataFrame, size: int = LENGTH, cell: int = CELL, most: int = BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of at most size. parts: any columns but these two, with `length` among them.

    A sequence id holds the turn, the cell and the number in the cell. Rows are dealt by a number of their own, so repeated ones are packed each, and
    do not crowd one cell. No rows: no rows.
    """
    names = parts.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = inner[names.index("length")]
    numbered = settle(parts.toDF(*inner).withColumn("nr", F.monotonically_increasing_id()), "pack-numbered")
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, parts.schema.fields))
    out = schema(f"{kinds}, nr long, sequence_id long, offset long, room long")
    kept = [*inner, "nr"]

    def turn_of(turn: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:  # not pandas, where a null makes doubles of the ids
            lengths = rows[at].to_numpy()
            if turn:
                places: dict[int, list[int]] = {}
                for i, b in enumerate(rows["sequence_id"].to_pylist()):
                    places.setdefault(b, []).append(i)
                bins = improve([places[b] for b in sorted(places)], lengths, size)
            else:
                bins = pack_cell(lengths, size)
            number, offset, room = (np.empty(len(lengths), np.int64) for _ in range(3))
            for b, members in enumerate(bins):
                m = np.array(members)
                ends = lengths[m].cumsum()
                number[m], offset[m], room[m] = b, ends - lengths[m], size - ends[-1]
            rows = rows.select(kept)
            for name, values in {"sequence_id": (turn << 56) + (key[0].as_py() << 20) + number, "offset": offset, "room": room}.items():
                rows = rows.append_column(name, pa.array(values))
            return rows

        return run

    def dealt(rows: DataFrame, by: str, cells: int, turn: int) -> DataFrame:
        return settle(rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(turn), by), F.lit(cells))).groupBy("cell").applyInArrow(turn_of(turn), out), "pack-turn")

    found = dealt(numbered, "nr", max(1, -(-numbered.count() // cell)), 0)
    done, pool, turn = [found.filter("room = 0")], [found.filter("room > 0")], 0
    for slack in (size // 4, size // 512, 0):
        rest, pool = reduce(DataFrame.unionByName, pool).filter(f"room > {slack}"), [p.filter(f"room <= {slack}") for p in pool if slack]
        while True:
            rows, before = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
            if not before:
                break
            cells, turn = max(-(-before // most), -(-rows // cell)), turn + 1
            found = dealt(rest, "sequence_id", cells, turn)
            after = found.agg(F.count_distinct("sequence_id")).first()[0]
            done.append(found.filter("room = 0"))
            rest = found.filter(f"room > {slack}")
            if slack:
                pool.append(found.filter(f"room BETWEEN 1 AND {slack}"))
            if cells == 1 or after == before:
                break
        pool.append(rest)
    return reduce(DataFrame.unionByName, [*done, *pool]).select(*inner, "sequence_id", "offset").toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(pieces(docs, tokenizer))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
