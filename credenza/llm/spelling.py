"""Spelling variants by anagram hashing.

Words are counted over all documents. The anagram key of a word is the sum of the fifth powers of its letters' code
points: words of the same letters share it, whatever their order, and for code points below 256 no two different exchanges
of one letter for another have the same difference of fifth powers, so that a difference of keys tells which
letters were added, removed or exchanged. Each word is entered under its own key and, for each of its distinct letters,
under its key less that letter's value. Words that differ by an added letter meet where the shorter's own key equals a
lessened key of the longer; words that differ by an exchange meet at two lessened keys. So every addition, removal and
exchange value is tried by one equi-join, without listing values that no word has. Of words that meet, the order of letters is
verified by an edit distance of exactly one.

A word's form is its near word with the largest count, if that is several times its own; following forms ends at a
root, since counts grow with each step.

Scale: a task hands on one row per word that it has met since its table was last emptied, and counts are combined
before the shuffle. One edit leaves the first three letters of two words of six letters or more, or else their last three,
the same; entries carry these, so that many words with the same letters in other orders (or a flood of invented words)
don't all meet under one key. Entries are written once and shuffled by both sides of the join, so adaptive execution can
split a common key. Roots are found by pointer jumping over saved tables: as many rounds as the logarithm of the longest
chain, which counts keep under 28.

Defined cases: null, empty and blank texts have no words; a null id is spelled as the empty text; very long texts and words
are read whole; repeated rows count each time; columns beside id and text are not read; an empty table, or one
without frequent words, gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credenza.llm.common import drop_saved, save, slices

#: Words have so many letters and occurrences; a form so many times a word's; one of DROP runs loses a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
#: Latin-1 bytes: A-Z to a-z, a-z and from \xC0 on as they are, all others (and what Latin-1 lacks) to spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
POWER = np.arange(256, dtype=np.int64) ** 5
#: Letters that one edit leaves alone at one of a word's ends.
END = 3
#: Distinct words that a task counts before it hands them on.
MOST = 400_000


def run_counter(least: int, drop: int):
    """Batches of (id, text) to (word, n): runs of at least so many letters, one of `drop` without a letter."""
    find = re.compile(rb"[^ ]{%d,}" % least).findall

    def rows(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        crc = zlib.crc32
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = Counter(find(text.encode("latin-1", "replace").translate(LETTERS))) if text else {}
                    salt = crc(f"{'' if doc is None else doc}:".encode())
                    for word in own:
                        h = crc(word if word.isascii() else word.decode("latin-1").encode(), salt)
                        if not h % drop:
                            n, at = own[word], h % len(word)
                            counts[word] -= n
                            if len(word) > least:
                                counts[word[:at] + word[at + 1 :]] += n
                    counts.update(own)
                if len(counts) > MOST:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct words of at least so many letters and their occurrences."""
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run_counter(least, drop), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to its entries (key, letter, word, n): its own key with letter 0, and its key less each distinct letter."""
    for batch in batches:
        raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        if not raw:
            continue
        letters = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.array([len(w) for w in raw])
        key = np.add.reduceat(POWER[letters], np.cumsum(sizes) - sizes)
        distinct = np.unique(np.repeat(np.arange(len(raw)) << 8, sizes) + letters)
        row, letter = np.r_[np.arange(len(raw)), distinct >> 8], np.r_[np.zeros(len(raw), dtype=np.int64), distinct & 255]
        taken = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(key[row] - POWER[letter]), pa.array(letter.astype(np.int32)), *taken.columns], ["key", "letter", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, n (words of six Latin-1 letters or more). Pairs (word, n, other, m) that one edit apart, in both orders."""
    each = words.mapInArrow(entries, "key bigint, letter int, word string, n bigint")
    ends = F.explode(F.array(F.struct(F.lit(True).alias("head"), F.substring("word", 1, END).alias("part")), F.struct(F.lit(False).alias("head"), F.expr(f"right(word, {END})").alias("part"))))
    placed = save(each.withColumn("end", ends).select("key", "letter", "word", "n", "end.head", "end.part"), "entries")
    # An own key (letter 0) meets lessened keys of words with one letter more; a lessened key those with another letter.
    a = placed
    b = placed.filter("letter > 0").select("key", "head", "part", F.col("letter").alias("b_letter"), F.col("word").alias("other"), F.col("n").alias("m"))
    met = a.join(b, ["key", "head", "part"]).filter("letter < b_letter").filter(F.levenshtein("word", "other", 1) == 1)
    # A pair with both ends alike is taken by its heads.
    once = met.filter(F.col("head") | (F.substring("word", 1, END) != F.substring("other", 1, END)))
    orders = F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    return once.select(F.explode(orders).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (null: none). Adds root: the last word that is reached by following forms."""
    now = save(forms.select("word", F.col("form").alias("up")).filter("up IS NOT NULL"), "roots")
    moved = 1
    while moved:
        next_up = now.select(F.col("word").alias("up"), F.col("up").alias("further"))
        new = save(now.join(next_up, "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        drop_saved(now)
        now = new.select("word", "up")
    return forms.join(now, "word", "left").select(*forms.columns, F.coalesce("up", "word").alias("root"))


def variants(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, n, n_near (near words), form and form_n (the near word of largest n, if times as frequent; ties: the
    first by code points), root."""
    if least < 2 * END:
        raise ValueError(f"words of fewer than {2 * END} letters may differ at both ends")
    words = save(word_counts(docs, least, drop, id_col, text_col).filter(F.col("n") >= least_count), "words")
    # The least of (-m, other) without sorting: the largest count, then the first word that has it.
    near = save(near_pairs(words), "near")
    top = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("m").alias("form_n"))
    best = near.join(top, "word").filter("m = form_n").groupBy("word").agg(F.min("other").alias("form"), F.first("n_near").alias("n_near"), F.first("form_n").alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    return roots(save(found, "forms"))
