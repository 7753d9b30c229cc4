"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.session import on_workers

from .arrow import batches_of, rows
from .vocab import line_break, sign_tail, units_of

_CODECS: dict[tuple, "BpeCodec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of least rank.

    A segment tree over byte positions holds at each leaf rank * width + position of the pair that starts
    there, so its root is the leftmost minimum. A merge changes three leaves: the merged pair's, the right
    part's (gone) and the left neighbour's; each is a point update of logarithmic cost. Live neighbours are
    kept in two link arrays.
    """
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (len(ranks) + 1 << 8) * width
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts at a position
    before = list(range(-1, n - 1))  # start of the token before it

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    while (top := tree[1]) < none:
        i = top % width
        j = end[i]
        stop = end[i] = end[j]
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            put(i, none if r is None else r * width + i)
        else:
            put(i, none)
        if j < n - 1:
            put(j, none)
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            put(h, none if r is None else r * width + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class BpeCodec(dict):
    """Unit of text -> its decimal ids joined by commas, in a cache of bounded size; see vocab.units_of."""

    def __init__(self, path: str, pattern: str, most: int = 600_000):
        super().__init__()
        self.ranks, self.most = read_ranks(path), most
        self.pattern = regex.compile(pattern)
        self.bytes_of = {str(i): token for token, i in self.ranks.items()}

    def ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(unit):
            if m[0]:
                out += merge_piece(m[0].encode("utf-8"), self.ranks)
        return out

    def __missing__(self, unit: str) -> str:
        word = unit[1:] if unit[:1] == " " else unit
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):  # one piece for certain
            out = ",".join(map(str, merge_piece(unit.encode("utf-8"), self.ranks)))
        elif at := sign_tail(unit):
            return f"{self[unit[:at]]},{self[unit[at:]]}"
        elif at := line_break(unit):
            return f"{self[unit[:at]]},{self['\n']},{self[unit[at + 1 :]]}"
        else:
            out = ",".join(map(str, self.ids(unit)))
        if len(self) >= self.most:
            self.clear()
        self[unit] = out
        return out

    def encode(self, text: str) -> str:
        """The text's decimal ids joined by commas."""
        units = units_of(text)
        units[1:] = [" " + u for u in units[1:]]
        return ",".join(map(self.__getitem__, units))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def codec(path: str, pattern: str) -> BpeCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BpeCodec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of the text's ids (array<int>); other columns stay. A null text gives an empty array.

    The vocabulary must hold every byte. No special tokens: their strings are ordinary text. Texts are
    taken whole; a piece of n bytes costs n log n.
    """
    on_workers(docs.sparkSession)
    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(path, pattern)
        return texts.map(lambda t: [int(i) for i in s.split(",")] if t and (s := c.encode(t)) else [])

    return docs.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that an id array stands for; null gives no bytes. Unknown ids are an error."""
    on_workers(df.sparkSession)
    @F.pandas_udf("binary")
    def undo(col):
        c = codec(path, pattern)
        return col.map(lambda x: c.decode(",".join(map(str, x))) if x is not None else b"")

    return df.withColumn(out, undo(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    One row for each row of docs, with no shuffle; ids never leave the task. Null text: empty, no tokens.
    Repeated rows and null ids stay rows of their own, extra columns are ignored, an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = codec(path, pattern)

        def found():
            for doc, text in rows(batches):
                ids = c.encode(text or "")
                yield doc, ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(c.decode(ids)).hexdigest()

        return batches_of(found(), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
