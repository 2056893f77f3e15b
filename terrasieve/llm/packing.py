"""Texts put into containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer's ranks lie on every node, and its pre-tokenisation pattern (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that one packing task handles; more texts are hashed to more packings.
TEXTS_PER_PACKING = 25_000
#: Longest run of characters encoded at once; longer texts are cut before a blank between words.
RUN_CHARS = 200_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text; 0 for null. Very long texts are encoded in runs cut before a blank that stands
    between two letters, where the pattern always starts a new piece, so that the sum is exact."""
    if not text:
        return 0
    encode = encoder(path).encode_ordinary
    if len(text) <= RUN_CHARS:
        return len(encode(text))
    total, start = 0, 0
    while start < len(text):
        cut = min(len(text), start + RUN_CHARS)
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        total += len(encode(text[start:cut]))
        start = cut
    return total


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every text; equal texts in one batch are encoded once."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str | None, int] = {}
            sizes = []
            for text in batch[text_col]:
                if text not in known:
                    known[text] = count_tokens(text, tokenizer)
                sizes.append(known[text])
            yield pd.DataFrame({id_col: batch[id_col], "n_tokens": sizes})

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, n_tokens long")


class SumOfSquares:
    """Online packing: each item goes where the sum over gaps of (open bins with that gap) squared becomes least.

    open_[g]: stack of the open bins with residual gap g; a full bin isn't open. Ties go to the
    smaller resulting gap.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        self.open_: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> int:
        """The item's bin. Moving a bin from gap g to g - size changes the sum by 2 (n[g-size] - n[g] + 1), or less at the ends."""
        c, n = self.capacity, self.n
        new_gap = c - size
        best_gap, best = 0, (2 * int(n[new_gap]) + 1 if new_gap else 0)
        if size < c:
            gaps = np.arange(size, c)  # open gaps that hold the item
            here = n[size:c]
            after = n[: c - size]
            delta = 2 * (after - here) + 2
            delta[0] = 1 - 2 * here[0]  # the bin becomes full and isn't counted any more
            delta[here == 0] = np.iinfo(np.int64).max
            k = int(delta.argmin())
            if delta[k] <= best and here[k]:
                best_gap, best = int(gaps[k]), int(delta[k])
        if best_gap:
            bin_ = self.open_[best_gap].pop()
            n[best_gap] -= 1
            left = best_gap - size
        else:
            bin_, self.bins, left = self.bins, self.bins + 1, new_gap
        if left:
            self.open_[left].append(bin_)
            n[left] += 1
        return bin_


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size (0..capacity) by sum-of-squares; empty items join the last container opened, or the first."""
    packer = SumOfSquares(capacity)
    out = np.zeros(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        out[i] = packer.place(size) if size else max(0, packer.bins - 1)
    return out


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, part_no, token_start, n_tokens, container): where every text goes.

    Only texts of more than capacity tokens are cut: into full containers and one rest, which is
    packed like a text; part_no counts from 0 and token_start is the part's first token. Null and
    empty texts have no tokens and share another text's container. Repeated texts are packed
    singly; an empty table gives an empty one; other columns don't matter.

    The texts are hashed to packings of bounded size, each packed by itself in the fixed order of
    a hash of the id, so that the waste of a packing's last open containers stays small against
    its contents. A text is one row there, its rest, however long it is: full containers need no
    packing and are written out afterwards. Only ids and sizes are shuffled.
    """
    sizes = token_counts(df, id_col, text_col, tokenizer)
    packings = max(1, round(df.count() / TEXTS_PER_PACKING))
    kind = df.schema[id_col].dataType.simpleString()
    full = F.floor(F.col("n_tokens") / capacity).cast("long")
    rests = sizes.select(
        id_col, full.alias("_full"), (F.col("n_tokens") - full * capacity).alias("_rest"),
        F.pmod(F.xxhash64(id_col), F.lit(packings)).cast("int").alias("_pack"), F.xxhash64(id_col, F.lit("order")).alias("_order"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", id_col], kind="stable")
        bins, rest = pack_sizes(pdf["_rest"].to_numpy(), capacity), pdf["_rest"].to_numpy()
        names = [f"{p}-{b}" if r or not f else None for p, b, r, f in zip(pdf["_pack"], bins, rest, pdf["_full"])]
        return pdf[[id_col, "_full", "_rest"]].assign(_name=names, _nth=np.arange(len(pdf)), _pack=pdf["_pack"])

    packed = rests.groupBy("_pack").applyInPandas(pack, f"`{id_col}` {kind}, _full long, _rest long, _name string, _nth long, _pack int")
    last = F.when(F.col("_name").isNotNull(), F.col("_full")).otherwise(F.col("_full") - 1)  # texts of exactly full containers have no rest
    parts = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_part"))
    is_full = F.col("_part") < F.col("_full")
    own = F.concat_ws("-", F.col("_pack").cast("string"), F.lit("full"), F.col("_nth").cast("string"), F.col("_part").cast("string"))
    return parts.select(
        id_col, F.col("_part").cast("int").alias("part_no"), (F.col("_part") * F.lit(capacity).cast("long")).alias("token_start"),
        F.when(is_full, F.lit(capacity).cast("long")).otherwise(F.col("_rest")).alias("n_tokens"), F.when(is_full, own).otherwise(F.col("_name")).alias("container"),
    )
