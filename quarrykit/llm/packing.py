"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import partitions, stored

CAPACITY = 4096
END_ID = 1
#: Words, and words of plain letters, whose ids a Python worker remembers (about 350 MB); a memory is emptied when it is full.
REMEMBERED, REMEMBERED_LETTERS = 600_000, 1_200_000
#: Python splits at these control characters, the tokenizer doesn't; texts that hold one are tokenized whole.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Letters of one code point that lower-case to letters of one code point, alike in Python and the tokenizer.
_PLAIN = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_MARKS = ".,!?;:"


# fixed values: what a tokenizer's file says if it takes texts apart into words as below
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_WORD_END = "</w>"


def by_words(tokenizer) -> bool:
    """Whether a tokenizer splits at white space, drops it and marks the ends of words, as its own settings say.

    An added token is looked for before that, in the text as it is: it must lie inside a word, and not in one of plain letters and marks, which are learnt in lower case.
    """
    said = json.loads(tokenizer.to_str())
    if any(x["content"].split() != [x["content"]] or _PLAIN.fullmatch(x["content"].strip(_MARKS) or "a") for x in said["added_tokens"]):
        return False
    normalizers = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in (said["normalizer"] or {}).get("normalizers", ())]
    splits = (said["pre_tokenizer"] or {}).get("pretokenizers", ({},))
    first = {k: splits[0].get(k) for k in ("type", "pattern", "behavior", "invert")}
    return (
        normalizers == _NORMALIZERS and first == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        and [x["type"] for x in splits[1:]] == ["ByteLevel"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and said["model"].get("end_of_word_suffix") == _WORD_END
    )


class _Words(dict):
    """Ids of a white-space-delimited word, as little-endian unsigned 32-bit bytes, for tokenizers that go ``by_words``; others get whole texts.

    The tokenizer never joins characters across white space (it splits there and drops it), so ids of
    a text are those of its words in order. It also splits letters from other characters. So words of plain letters
    are learnt many at a time, from one text of all of them: the id that ends a word is marked in the vocabulary.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.apart = by_words(self.tokenizer)
        self.letters: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith(_WORD_END)]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        split, others = [], []
        for w in new:
            plain = w.rstrip(_MARKS)
            if _PLAIN.fullmatch(plain):
                split.append((w, plain.lower(), w[len(plain) :]))
            else:
                others.append(w)
        fresh = list({core for _, core, _ in split if core not in self.letters})
        if len(self.letters) + len(fresh) > REMEMBERED_LETTERS:
            self.letters.clear()
            fresh = list({core for _, core, _ in split})
        for lo in range(0, len(fresh), 4096):
            self._learn_letters(fresh[lo : lo + 4096])
        for w, core, marks in split:
            self[w] = self.letters[core] + self._marks(marks) if marks else self.letters[core]
        for w in others:
            self[w] = self.ids(w)

    def _learn_letters(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(words):
            raw, begin = ids.tobytes(), 0
            for word, end in zip(words, (4 * (last + 1)).tolist(), strict=True):
                self.letters[word] = raw[begin:end]
                begin = end
        else:
            for word in words:
                self.letters[word] = self.ids(word)

    def _marks(self, marks: str) -> bytes:
        found = self.letters.get(marks)
        if found is None:
            found = self.letters[marks] = self.ids(marks)
        return found


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """All ids of each text and the end id, as little-endian unsigned 32-bit bytes."""
    known, end = _words(path), END_ID.to_bytes(4, "little")
    if not known.apart:
        yield from (known.ids(text or "") + end for text in texts)
        return
    split = [None if t is not None and any(c in t for c in _SEPARATORS) else (t or "").split() for t in texts]
    known.learn(set().union(*(x for x in split if x is not None)))
    for text, words in zip(texts, split, strict=True):
        yield (known.ids(text) if words is None else b"".join(map(known.__getitem__, words))) + end


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text (``PIECES``); ``ids`` is null unless ``keep_ids``. A file's own truncation and padding don't apply.

    ``tokenizer_path`` must name the same file on every executor. Null texts count as empty: one piece
    that holds the end id. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 4 * capacity
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = []
                part = batch.iloc[lo : lo + 256]
                for doc_id, ids in zip(part.doc_id.array, token_bytes(part.text.tolist(), tokenizer_path), strict=True):
                    for k, at in enumerate(range(0, len(ids), size)):
                        own = ids[at : at + size]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, PIECES)


class _Lengths:
    """How many pieces of each length are left, with single, pair and triple sums found by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        self.bits = 0  # bit n: some of length n are left
        self.mirror = 0  # bit capacity - n: the same
        self.capacity = capacity
        for n, count in counts.items():
            self.add(n, count)

    def add(self, n: int, count: int) -> None:
        self.left[n] += count
        if self.left[n]:
            self.bits |= 1 << n
            self.mirror |= 1 << (self.capacity - n)
        else:
            self.bits &= ~(1 << n)
            self.mirror &= ~(1 << (self.capacity - n))

    def pairs(self, total: int, at_most: int) -> int:
        """Bit n is set if lengths n and total - n are both left and n is between half of total and at_most."""
        shift = self.capacity - total
        other = self.mirror >> shift if shift >= 0 else self.mirror << -shift
        both = self.bits & other & ((1 << (at_most + 1)) - 1)
        return both >> (half := (total + 1) // 2) << half

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, the largest possible first; None if there are none."""
        if self.left[gap]:
            return (gap,)
        pair = self.pairs(gap, gap - 1)
        while pair:
            a = pair.bit_length() - 1
            if 2 * a != gap or self.left[a] > 1:
                return a, gap - a
            pair &= ~(1 << a)
        firsts = self.bits & ((1 << max(0, gap - 1)) - 1)
        while firsts:
            a = firsts.bit_length() - 1
            if 3 * a < gap:
                return None
            firsts &= ~(1 << a)
            pair = self.pairs(gap - a, min(a, gap - a - 1))
            while pair:
                b = pair.bit_length() - 1
                found = (a, b, gap - a - b)
                if all(self.left[n] >= found.count(n) for n in found):
                    return found
                pair &= ~(1 << b)
        return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places for pieces of given length counts, and the number of sequences.

    A row of the plan (length, first rank, sequences, copies, first sequence, offset) says: the pieces of
    that length whose ranks begin there fill ``copies`` places from ``offset`` in each of so many sequences
    in a row. Steps take as many pieces at once as the counts allow, so the plan has a size bounded by the
    number of lengths (``capacity``), not of pieces.

    First, from the longest length down, combinations that leave no gap are used up; then the rest is packed
    best-fit, longest first, into the tightest gap that takes it.
    """
    lengths, taken, rows, n_sequences = _Lengths(counts, capacity), dict.fromkeys(counts, 0), [], 0

    def place(n: int, sequences: int, copies: int, first: int, offset: int) -> None:
        rows.append((n, taken[n], sequences, copies, first, offset))
        taken[n] += sequences * copies
        lengths.add(n, -sequences * copies)

    unfilled = []
    for n in range(capacity, 0, -1):
        while lengths.left[n]:
            gap = capacity - n
            if gap:
                lengths.add(n, -1)  # it must not fill its own gap
                fill = lengths.exact(gap)
                lengths.add(n, 1)
                if fill is None:
                    unfilled.append((n, lengths.left[n]))
                    lengths.add(n, -lengths.left[n])
                    break
            else:
                fill = ()
            whole = (n, *fill)
            sequences = min(lengths.left[x] // whole.count(x) for x in set(whole))
            offset = 0
            for x in sorted(set(whole), reverse=True):
                place(x, sequences, whole.count(x), n_sequences, offset)
                offset += x * whole.count(x)
            n_sequences += sequences
    for n, count in unfilled:
        lengths.add(n, count)
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    for n in range(capacity, 0, -1):
        while lengths.left[n]:
            left = lengths.left[n]
            gap = min((g for g in open_ if g >= n), default=None)
            if gap is None:  # new sequences
                per = min(capacity // n, left)
                sequences = left // per
                place(n, sequences, per, n_sequences, 0)
                if capacity - per * n:
                    open_.setdefault(capacity - per * n, []).append((n_sequences, sequences))
                n_sequences += sequences
                continue
            first, sequences = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            per = min(gap // n, left)
            used = min(sequences, left // per)
            place(n, used, per, first, capacity - gap)
            if used < sequences:
                open_.setdefault(gap, []).append((first + used, sequences - used))
            if gap - per * n:
                open_.setdefault(gap - per * n, []).append((first, used))
    return np.array(rows, dtype=np.int64).reshape(-1, 6), n_sequences


def _placer(plan: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    limit = int((plan[:, 1] + plan[:, 2] * plan[:, 3]).max(initial=0)) + 1
    keys = plan[:, 0] * limit + plan[:, 1] if limit < 2**50 else None
    if keys is None:
        raise ValueError("more pieces than ranks can number")

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = plan[np.searchsorted(keys, length * limit + rank, side="right") - 1]
        within = rank - row[:, 1]
        return row[:, 4] + within // row[:, 3], row[:, 5] + within % row[:, 3] * length

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (with ``length`` between 1 and ``capacity``), in as few sequences as it can.

    The driver sees how many pieces have each length (``capacity`` numbers at most) and plans on those alone. Pieces
    are numbered within their length: partitions of salted lengths count themselves, and each number is moved on by
    the counts before, so a length that a third of all pieces have is spread like any other. Pieces of one length
    are interchangeable; repeated rows are placed one by one. No pieces give no sequences.
    """
    salts = partitions(pieces.sparkSession)
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    counts = stored(keyed.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    plan, _ = plan_packing({int(n): int(c) for n, c in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    place = _placer(plan)
    before = counts.selectExpr("length", "_salt", "CAST(coalesce(sum(n) OVER (PARTITION BY length ORDER BY _salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS long) AS _before")
    ranked = keyed.selectExpr("*", "row_number() OVER (PARTITION BY length, _salt ORDER BY doc_id, piece) - 1 AS _own")
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = ranked.withColumn("_at", placed(F.col("length"), F.col("_rank").cast("long")))
    return at.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def assemble(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``doc_ids`` and ``ids`` (binary, pieces in order of offset) of pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # capacity bounds a sequence
    found = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return found.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``tokenize_pieces`` then ``pack``; pieces are stored in between, so texts are read and tokenized once."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, keep_ids, id_col, text_col)
    pieces = stored(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, capacity)
