"""SentencePiece encoding and decoding; giant documents by a max-plus scan.

Blanks become the mark U+2581 and one mark is put in front, as the model asks.  No piece has a mark behind another
character, so a text falls apart into units (marks, then other characters) that are encoded on their own: each distinct
unit of a batch goes through the library once, and a text's ids are those of its units.

A text of `GIANT` characters or more is cut into chunks anywhere.  The state at a cut is the piece that covers it: where
it starts and how far it reaches over.  A sequence of pieces is the encoding exactly if each neighbouring pair encodes to
itself, so a chunk's transfer matrix holds, for each piece over its first cut and each over its last, the best sum of
scores of a path between them, minus infinity where no path has valid pairs only.  Matrices are combined by max-plus
products in a tree, the best states at the cuts follow from them, and each chunk then lays out its own pieces.  A chunk
with a unit boundary needs paths only before its first and behind its last one; in between stands the units' encoding.

Decoding puts the pieces' bytes in a row, turns marks into blanks and drops the first.

Nulls: a null text has no ids and decodes to an empty one; so has an empty text.  A mark that a text holds itself reads
as a blank.  Repeated rows give repeated results, an empty table none; extra columns take no part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from lectern.llm.common import stored

MARK = "▁"
GIANT = 1 << 16
CHUNK = 1 << 14
#: Units whose ids a worker remembers; it only saves time.
REMEMBERED = 300_000
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+\\Z")
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
State = tuple[int, int]  #: start of the piece over a cut (0 or less before it), and its end, both from the cut


class Codec:
    """Pieces, scores and pair rules of one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.mark = self.ids[MARK]
        self.bytes = [b""] * n
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes((b,))
        self.units: dict[str, bytes] = {}
        self.valid = lru_cache(1 << 20)(lambda left, right: self.merged(left + right) == [left, right])
        self.whole = lru_cache(1 << 17)(lambda piece: self.merged(piece) == [piece])

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units]
        # The library puts a mark of its own in front of what it encodes; a lone mark has nothing behind it.
        for u, ids in zip(new, self.model.encode([u[1:] for u in new], num_threads=1)):
            self.units[u] = array("i", ids if len(u) > 1 else [self.mark]).tobytes()
        if len(self.units) > REMEMBERED:
            self.units = {u: self.units[u] for u in units}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        split = [_UNITS.findall(marked(t)) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.units.__getitem__, us)) for us in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of `ids`."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode(errors="replace")

    def merged(self, text: str) -> list[str]:
        """A short text by the model's rule: the best neighbouring pair that is a piece is joined, the left one first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pieces(self, text: str, end: int) -> Iterator[int]:
        """Starts of the pieces of `text` that end at `end`; a single character always is one."""
        yield end - 1
        for start in range(end - 2, max(-1, end - self.longest - 1), -1):
            piece = text[start:end]
            if piece in self.ids and self.whole(piece):
                yield start

    def states(self, text: str, cut: int) -> list[State]:
        """All pieces over a cut, as places in `text`; none but the start's own at the start of the text."""
        if cut == 0:
            return [(0, 0)]
        return [(s, e) for e in range(cut, min(len(text), cut + self.longest - 1) + 1) for s in self.pieces(text, e)
                if s < cut]

    def paths(self, text: str, entry: State, upto: int) -> dict[int, tuple[int, float]]:
        """From a piece already laid: each end up to `upto` that valid pieces reach -> start of the last, sum of scores."""
        reached = {entry[1]: (entry[0], 0.0)}
        for end in range(entry[1] + 1, upto + 1):
            for start in self.pieces(text, end):
                if start in reached:
                    before, total = reached[start]
                    piece = text[start:end]
                    if before == start or self.valid(text[before:start], piece):
                        found = (start, total + self.scores.get(piece, 0.0))
                        if end not in reached or found[1] > reached[end][1]:
                            reached[end] = found
        return reached

    def lay(self, text: str, entry: State, end: int) -> bytes:
        """The ids behind `entry` up to the piece that ends at `end`."""
        reached, out = self.paths(text, entry, end), []
        while end > entry[1]:
            start = reached[end][0]
            piece = text[start:end]
            out.append([self.ids[piece]] if piece in self.ids else [self.byte[b] for b in piece.encode()])
            end = start
        return array("i", [i for ids in reversed(out) for i in ids]).tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


class Chunk:
    """A chunk within its margins: `text[first:last]` is its own, the rest is there for the pieces over its cuts."""

    def __init__(self, c: Codec, text: str, first: int, last: int, ends: bool):
        self.c, self.text, self.first, self.last, self.ends = c, text, first, last, ends
        self.entries = c.states(text, first)
        self.exits = [(s, e) for s, e in c.states(text, last) if e == last] if ends else c.states(text, last)
        cuts = [m.start() for m in _CUT.finditer(text, first, last)]
        cuts = [x for x in cuts if x >= first + c.longest] if first else cuts
        self.head, self.tail = (cuts[0], cuts[-1]) if cuts else (None, None)

    def _reach(self, entry: State, upto: int) -> dict[int, tuple[int, float]]:
        return self.c.paths(self.text, entry, upto)

    def matrix(self) -> np.ndarray:
        """Best sums of scores from each entry to each exit."""
        far = max((e for _, e in self.exits), default=self.last)
        out = np.full((len(self.entries), len(self.exits)), -np.inf)

        def ends(entry: State, base: float, row: np.ndarray) -> None:
            reached = self._reach(entry, far)
            for j, (s, e) in enumerate(self.exits):
                if s < entry[1] and (s, e) == entry:
                    row[j] = base
                elif e in reached and e > entry[1]:
                    if reached[e][0] == s:
                        row[j] = base + reached[e][1]

        if self.head is None:
            for i, entry in enumerate(self.entries):
                ends(entry, 0.0, out[i])
            return out
        tail = np.full(len(self.exits), -np.inf)
        ends((self.tail, self.tail), 0.0, tail)
        for i, entry in enumerate(self.entries):
            reached = self._reach(entry, self.head)
            if self.head in reached:
                out[i] = reached[self.head][1] + tail
        return out

    def lay(self, entry: State, exit: State) -> bytes:
        """The ids of the pieces that end in this chunk, behind `entry` and up to `exit`."""
        if self.head is None:
            return self.c.lay(self.text, entry, exit[1])
        units = _UNITS.findall(self.text[self.head:self.tail])
        self.c.learn(set(units))
        return self.c.lay(self.text, entry, self.head) + b"".join(map(self.c.units.__getitem__, units)) + self.c.lay(
            self.text, (self.tail, self.tail), exit[1])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The best state at each cut, the first and the last one included, by products combined in a tree."""

    def walk(lo: int, hi: int, tree: dict, start: int, end: int, out: list[int]) -> None:
        if hi - lo == 1:
            out.append(end)
            return
        middle = (lo + hi) // 2
        via = int(np.argmax(tree[lo, middle][start] + tree[middle, hi][:, end]))
        walk(lo, middle, tree, start, via, out)
        walk(middle, hi, tree, via, end, out)

    def build(lo: int, hi: int, tree: dict) -> np.ndarray:
        if hi - lo == 1:
            tree[lo, hi] = matrices[lo]
        else:
            middle = (lo + hi) // 2
            tree[lo, hi] = product(build(lo, middle, tree), build(middle, hi, tree))
        return tree[lo, hi]

    tree: dict = {}
    whole = build(0, len(matrices), tree)
    out = [0]
    walk(0, len(matrices), tree, 0, int(np.argmax(whole[0])), out)
    return out


def _chunk_of(c: Codec, row) -> Chunk:
    first = row.from_ - row.base
    return Chunk(c, row.chunk, first, row.upto - row.base, row.upto == row.size)


def _chunks(giants: DataFrame, chunk: int, margin: int) -> DataFrame:
    """(key, no, chunk, base, from_, upto, size): pieces of marked texts with `margin` characters on both sides."""
    text = F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK)))
    cut = giants.withColumn("marked", text).withColumn("size", F.length("marked")).withColumn(
        "from_", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(chunk))))
    base = F.greatest(F.lit(0), F.col("from_") - margin)
    return cut.select(
        "key", (F.col("from_") / chunk).cast("int").alias("no"),
        F.substring("marked", base + 1, F.col("from_") - base + chunk + margin).alias("chunk"), base.alias("base"),
        "from_", F.least(F.col("size"), F.col("from_") + chunk).alias("upto"), "size")


def encode_giants(texts: DataFrame, model: str, chunk: int = CHUNK, longest: int = 16) -> DataFrame:
    """(key, ids) from (key, text): one row per distinct giant text, ids as four-byte numbers.

    Chunks are spread over all tasks twice, for their matrices and for laying out their pieces; in between, a text's
    matrices, a few dozen numbers a chunk, meet in one task.
    """
    chunks = stored(_chunks(texts.dropDuplicates(["key"]), chunk, longest).repartition("key", "no"), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for batch in batches:
            found = [_chunk_of(c, r) for r in batch.itertuples()]
            yield pd.DataFrame({"key": batch["key"], "no": batch["no"],
                                "matrix": pd.Series([f.matrix().tobytes() for f in found], dtype=object),
                                "entries": [len(f.entries) for f in found]})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        rows = [np.frombuffer(m).reshape(n, -1) for m, n in zip(group["matrix"], group["entries"])]
        at = best_states(rows)
        return pd.DataFrame({"key": group["key"], "no": group["no"], "entry": at[:-1], "exit": at[1:]})

    def layout(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for batch in batches:
            found = [_chunk_of(c, r) for r in batch.itertuples()]
            yield pd.DataFrame({"key": batch["key"], "no": batch["no"], "ids": pd.Series(
                [f.lay(f.entries[i], f.exits[j]) for f, i, j in zip(found, batch["entry"], batch["exit"])],
                dtype=object)})

    moves = chunks.mapInPandas(matrices, "key binary, no int, matrix binary, entries int").groupBy("key").applyInPandas(
        states, "key binary, no int, entry int, exit int")
    laid = chunks.join(moves, ["key", "no"]).mapInPandas(layout, "key binary, no int, ids binary")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: F.hex(x["ids"]))
    return laid.groupBy("key").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def encode_documents(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids (four bytes each) of every document."""

    @pandas_udf(BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        c, out = codec(model), []
        for at in range(0, len(texts), 1000):
            out += c.encode(texts.iloc[at:at + 1000].tolist())
        return pd.Series(out, dtype=object)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = rows.where(F.length("text") < giant).withColumn("ids", encode("text"))
    large = rows.where(F.length("text") >= giant).withColumn("key", F.unhex(F.sha2(F.col("text"), 256)))
    found = encode_giants(large.select("key", "text"), model, chunk)
    return small.unionByName(large.join(found, "key").select("doc_id", "text", "ids"))


def encoded(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces and ids (four bytes each) of every document."""
    return encode_documents(docs, model, giant, chunk).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids")


def codec_report(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 of the ids, and of the decoded text n_chars and whether it equals the text."""

    @pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.decode(np.frombuffer(x, "<i4")) for x in ids], dtype=object)

    coded = encode_documents(docs, model, giant, chunk)
    return coded.withColumn("decoded", decode("ids")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").cast("long").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"),
        (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"))
