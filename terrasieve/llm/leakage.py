"""Evaluation texts in training text, by one Aho-Corasick automaton over their normalised words."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.session import new_folder

#: Characters of test items in one automaton; larger sets are worked off in blocks of that size.
BLOCK_CHARS = 16 << 20

_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_built: dict[str, Seeds] = {}


def normalise(text: str) -> str:
    """The text's words (runs of letters and digits), case-folded, with single blanks around each."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return " " + _GAP.sub(" ", text).strip().casefold() + " "


class Seeds:
    """Finds runs of at least least_words words that a text shares with one of the items.

    Every run of that length holds, whole, one of the item's word blocks that start at multiples
    of half its length. The automaton's patterns are these blocks; where it finds one, the run is
    extended word by word to both sides and counts if it is long enough.
    """

    def __init__(self, items: list[tuple[int, str]], least_words: int):
        import ahocorasick

        self.least, self.step = least_words, max(1, (least_words + 1) // 2)
        self.items = [(key, normalise(text).split()) for key, text in items]
        places = defaultdict(list)
        for n, (_, words) in enumerate(self.items):
            if len(words) >= least_words:
                for at in range(0, len(words) - self.step + 1, self.step):
                    places[" " + " ".join(words[at : at + self.step]) + " "].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for block, where in places.items():
            self.automaton.add_word(block, (len(block), where))
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def runs(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, item's first word, text's first word, words), each maximal run once."""
        if not self.any or not text:
            return []
        norm = normalise(text)
        hits = list(self.automaton.iter(norm))
        if not hits:
            return []
        words = norm.split()
        starts, at = {}, 1
        for k, w in enumerate(words):
            starts[at] = k
            at += len(w) + 1
        found, done = [], {}
        for end, (size, where) in hits:
            k = starts[end - size + 2]
            for n, at in where:
                key, mine = self.items[n]
                if done.get((n, k - at), -1) >= k:  # inside a run that is known
                    continue
                a, b = at, at + self.step
                while a > 0 and k - (at - a) > 0 and mine[a - 1] == words[k - (at - a) - 1]:
                    a -= 1
                while b < len(mine) and k + b - at < len(words) and mine[b] == words[k + b - at]:
                    b += 1
                done[n, k - at] = k + b - at - 1
                if b - a >= self.least:
                    found.append((key, a, k - (at - a), b - a))
        return found


def find_leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, least_words: int = 15) -> DataFrame:
    """(item_id, doc_id, n_words, char_start, char_end, item_word) of every maximal shared run.

    A run is least_words or more consecutive words of the item in the same order with no other
    word between; words are maximal runs of letters and digits, and letter case, punctuation and
    white space don't matter. Offsets are those of the original text. Items are taken in blocks
    of about half of BLOCK_CHARS, each with its own automaton and one pass over the texts. With
    several blocks each one's runs are written to the shared folder before the next block's items
    are read, so that driver and workers hold one block at a time. Null and empty texts and items
    shorter than least_words have no runs; equal items are all reported. Map-only: no text is shuffled.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id_col).cast("long").alias("k"), F.col(item_text_col).alias("t")).where("k is not null and t is not null and t <> ''")
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARS))
    schema = f"item_id long, doc_id {documents.schema[id_col].dataType.simpleString()}, n_words int, char_start int, char_end int, item_word int"
    texts = documents.select(id_col, text_col)

    def of_block(block: int):
        """The block's items as a broadcast, and the runs with them."""
        rows = sorted(tuple(r) for r in wanted.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).collect())
        name = hashlib.sha256(repr((rows, least_words)).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if name not in _built:
                _built.clear()
                _built[name] = Seeds(shared.value, least_words)
            seeds = _built[name]
            for batch in batches:
                found = []
                for doc, text in zip(batch[id_col], batch[text_col]):
                    if text and (runs := seeds.runs(text)):
                        spans = word_spans(text)
                        found += [(key, doc, n, spans[w][0], spans[w + n - 1][1], a) for key, a, w, n in runs]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "n_words", "char_start", "char_end", "item_word"])

        return shared, texts.mapInPandas(scan, schema)

    if blocks == 1:
        return of_block(0)[1]
    folder = new_folder(spark, "leaks")
    for block in range(blocks):
        shared, runs = of_block(block)
        runs.write.parquet(f"{folder}/block={block}")
        shared.destroy()
    return spark.read.schema(schema).parquet(*[f"{folder}/block={b}" for b in range(blocks)])


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of normalise(text) stands in the text itself."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return [m.span() for m in _WORD.finditer(text)]
    starts, composed = [], []
    at = 0
    for m in re.finditer(r".[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]*", text, re.S):  # a base letter and its marks
        piece = unicodedata.normalize("NFC", m[0])
        composed.append(piece)
        starts += [m.start() if i == 0 else m.end() - 1 for i in range(len(piece))]
        at = m.end()
    starts.append(at)
    return [(starts[m.start()], starts[m.end()]) for m in _WORD.finditer("".join(composed))]
