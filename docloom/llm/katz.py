"""Language-model scores by a Katz backoff model, learned from the whole corpus.

The probability of a word after a context of n - 1 words is the Good-Turing discounted count
of the n-gram over the count of the context where training rows hold the n-gram. It is
alpha(context) times the probability after the context's last n - 2 words where they hold
only the context, and just that probability where they don't hold the context either. alpha
is the mass that the discounts leave, divided by the mass that the shorter context gives to
words never seen here, so that every context sums to one. Words have the discounted count
over that of all tokens; the mass left goes in even shares to as many unseen words as there
are seen ones and one more.

Texts become chunks of word numbers once. Level by level each chunk sends its distinct
n-grams, with their counts in training rows, to the parts of the table of n-grams; a part adds
up what came, names its n-grams by consecutive numbers, keeps them with the sums that weights
need as rows of a Parquet table, and answers each chunk in the order of its entries. An
n-gram of all documents costs each chunk one entry. A context is known by its name, not by a
hash; only words are, by 64 bits. A context too frequent for one part is split by its next
word, and the sums of its pieces are added by a join.

A chunk and a part meet in one row, so rows grow with chunks times parts: CHUNK_BYTES and
PART_TOKENS are to be raised with the executors' memory on inputs of many terabytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, remainder, shuffle_partitions, squeezed, staged, unsqueezed
from .exchange import part_of, word_hashes

#: Words of an n-gram, at most. Any order works; the README has the figures of 3 beside those of 2.
ORDER = 2
#: Counts above this are not discounted.
GT_MAX = 5
#: Bytes of text of a chunk (a longer text is one), tokens of one part, and of one shuffle partition.
CHUNK_BYTES, PART_TOKENS, PARTITION_TOKENS = 4 << 20, 1 << 20, 8 << 20
#: Occurrences of a context that one part takes.
SPLIT_AT = 1 << 17
_END = b"\n"  # no word: the end of a text
_PIECE = np.int64(0x9E3779B1)
#: Sums of a context: how many n-grams it has with counts 1 to GT_MAX, the summed counts above, and the discounted counts of their tails.
_SUMS = GT_MAX + 2

_CHUNK = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.binary()) for c in ("ids", "no_id", "sizes", "train", "words", "counts", "tokens"))])
_ASKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("keys", "runs", "split", "words", "counts", "tails"))])
#: Answers to a chunk from a part; rows without a chunk are the part's n-grams, kept as the model.
_TOLD = pa.schema([
    ("level", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("counts", "names", "whole", "sums", "keys", "runs", "words")),
    ("totals", pa.list_(pa.int64())), ("split_keys", pa.list_(pa.int64())), ("split_sums", pa.list_(pa.list_(pa.float64()))),
])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_TYPES = {"int64": "bigint", "binary": "binary", "bool": "boolean", "double": "double", "list<item: int64>": "array<bigint>", "list<item: list<item: double>>": "array<array<double>>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[str(f.type)]}" for f in schema)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _cuts(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of each run of equal parts."""
    at = _begins(parts)
    return [(int(parts[a]), a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(parts)])]


def _begins(*values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(values[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(values[0]), bool)
    new[0] = True
    for x in values:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text as bytes, train) -> one row for each chunk of texts."""
    name = TaskContext.get().partitionId() << 32
    docs: list[tuple] = []
    size = 0

    def chunk() -> pa.RecordBatch:
        lists = [text.lower().split() for _, text, _ in docs]
        sizes = np.fromiter((len(w) + 1 for w in lists), np.int64, len(lists))
        hashes = word_hashes([w for words in lists for w in (*words, _END)])
        words, tokens = np.unique(hashes, return_inverse=True)
        train = np.array([bool(t) for _, _, t in docs], np.uint8)
        counts = np.bincount(tokens, np.repeat(train, sizes), len(words)).astype(np.int64)
        ids = np.array([0 if i is None else i for i, _, _ in docs], np.int64)
        row = {
            "chunk": name, "n_tokens": len(tokens), "ids": squeezed(ids), "no_id": squeezed(np.array([i is None for i, _, _ in docs], np.uint8)), "sizes": squeezed(sizes),
            "train": squeezed(train), "words": squeezed(words, True), "counts": squeezed(counts), "tokens": squeezed(tokens.astype(np.uint32)),
        }
        return _rows([row], _CHUNK).to_batches()[0]

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            for doc in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns)):
                docs.append(doc)
                size += len(doc[1])
                if size >= chunk_bytes:
                    yield chunk()
                    docs, size, name = [], 0, name + 1
    if docs:
        yield chunk()


class _Chunk:
    """A chunk's tokens as numbers of its distinct words."""

    def __init__(self, table: pa.Table):
        row = table.slice(0, 1).to_pylist()[0]
        self.name = row["chunk"]
        self.ids, self.no_id = unsqueezed(row["ids"], np.int64), unsqueezed(row["no_id"], np.uint8)
        self.sizes, self.train_docs = unsqueezed(row["sizes"], np.int64), unsqueezed(row["train"], np.uint8)
        self.tokens = unsqueezed(row["tokens"], np.uint32).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens)) - np.repeat(self.begins, self.sizes)
        self.train = np.repeat(self.train_docs, self.sizes).astype(np.float64)


@dataclass
class _Level:
    """The n-grams of a chunk: which one ends at each token (-1: none) and, once told, their counts and names."""

    of: np.ndarray
    count: np.ndarray
    name: np.ndarray  # none at the last level


@dataclass
class _Entries:
    """What a chunk asks of a level, in the order of parts, then of contexts."""

    at: np.ndarray  # tokens with a known context
    of: np.ndarray  # the entry of each
    part: np.ndarray
    key: np.ndarray
    split: np.ndarray  # of each entry: its context is split
    begins: np.ndarray  # where each context, or piece of one, begins
    context_count: np.ndarray  # of each of these
    word: np.ndarray
    tail: np.ndarray  # the count of the n-gram without its first word


def _entries(chunk: _Chunk, words: _Level, lower: _Level, n: int, parts: int, split_at: int) -> _Entries:
    at = np.flatnonzero(chunk.place >= n - 2)
    if n == 2:  # what begins a text has a context of its own, with the key 0 and as many occurrences as the end
        context = np.where(chunk.place[at] == 0, len(lower.count), chunk.tokens[at - 1])
        count = np.append(lower.count, lower.count[chunk.tokens[-1]])
        key = np.append(lower.name, -1) + 1
    else:
        context, count, key = lower.of[at - 1], lower.count, lower.name + 1
    known = context >= 0
    known[known] = count[context[known]] > 0
    at, context = at[known], context[known]
    token = chunk.tokens[at]
    group, split = context, count[context] >= split_at
    g_context, g_piece = np.arange(len(count)), np.zeros(len(count), np.int64)
    if split.any():
        pieces = (count[context[split]] // split_at + 1).astype(np.uint64)
        piece = (mix(words.name[token[split]].astype(np.uint64)) % pieces).astype(np.int64)
        kinds, of = np.unique(context[split] << 24 | piece, return_inverse=True)
        group = context.copy()
        group[split] = len(count) + of
        g_context, g_piece = np.concatenate((g_context, kinds >> 24)), np.concatenate((g_piece, kinds & 0xFFFFFF))
    g_key = key[g_context]
    g_part = (g_key + g_piece * _PIECE) % parts
    order = np.lexsort((g_piece, g_key, g_part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_name = np.argsort(words.name)
    word_rank = np.empty(len(by_name), np.int64)
    word_rank[by_name] = np.arange(len(by_name))
    found, first, of = np.unique(rank[group] * len(by_name) + word_rank[token], return_index=True, return_inverse=True)
    e_group = order[found // len(by_name)]
    begins = _begins(e_group)
    head = g_context[e_group[begins]]
    return _Entries(at, of, g_part[e_group], g_key[e_group], split[first], begins, count[head].astype(np.float64), words.name[by_name[found % len(by_name)]], _tails(chunk, words, lower, n, at[first]))


def _tails(chunk: _Chunk, words: _Level, lower: _Level, n: int, at: np.ndarray) -> np.ndarray:
    return words.count[chunk.tokens[at]] if n == 2 else lower.count[lower.of[at]]


def _told(told: pa.Table, level: int, split: bool = False) -> list[dict]:
    """The answers of a level in the order of parts, or the rows about split contexts."""
    level_at, part = told.column("level").to_numpy(), told.column("part").to_numpy()
    at = np.flatnonzero((level_at == level) & ((part < 0) == split))
    return told.take(pa.array(at[np.argsort(part[at], kind="stable")])).to_pylist()


def _first_level(chunk: _Chunk, told: pa.Table, parts: int) -> _Level:
    rows = _told(told, 1)
    count = np.concatenate([unsqueezed(r["counts"], np.int64) for r in rows])
    name = np.concatenate([unsqueezed(r["names"], np.int64) * parts + r["part"] for r in rows])
    return _Level(chunk.tokens, count, name)


def _next_level(chunk: _Chunk, entries: _Entries, told: list[dict], parts: int) -> _Level:
    of = np.full(len(chunk.tokens), -1, np.int64)
    of[entries.at] = entries.of
    empty = [np.zeros(0, np.int64)]
    return _Level(of, np.concatenate(empty + [unsqueezed(r["counts"], np.int64) for r in told]), np.concatenate(empty + [unsqueezed(r["names"], np.int64, True) * parts + r["part"] for r in told if r["names"]]))


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What chunks (chunk, words, counts) ask of the words' table."""
    for batch in batches:
        for row in batch.to_pylist():
            words, counts = unsqueezed(row["words"], np.uint64, True), unsqueezed(row["counts"], np.int64)
            asked = [{"part": p, "chunk": row["chunk"], "words": squeezed(words[a:b], True), "counts": squeezed(counts[a:b])} for p, a, b in _cuts(part_of(words, parts))]
            yield from _rows(asked, _ASKED).to_batches()


def _ask(table: pa.Table, told: pa.Table, n: int, parts: int, split_at: int) -> pa.Table:
    """What a chunk asks of level n, once levels below n have been told."""
    if not table.num_rows:
        return _ASKED.empty_table()
    chunk = _Chunk(table)
    words = lower = _first_level(chunk, told, parts)
    for level in range(2, n):
        lower = _next_level(chunk, _entries(chunk, words, lower, level, parts, split_at), _told(told, level), parts)
    e = _entries(chunk, words, lower, n, parts, split_at)
    counts = np.bincount(e.of, chunk.train[e.at], len(e.word)).astype(np.int64)
    rows = []
    for p, a, b in _cuts(e.part):
        begins = e.begins[np.searchsorted(e.begins, a) : np.searchsorted(e.begins, b)]
        rows.append({
            "part": p, "chunk": chunk.name, "keys": squeezed(e.key[begins], True), "runs": squeezed(np.diff(np.append(begins, b)).astype(np.uint32)), "split": squeezed(e.split[begins].astype(np.uint8)),
            "words": squeezed(e.word[a:b]), "counts": squeezed(counts[a:b]), "tails": squeezed(e.tail[a:b]),
        })
    return _rows(rows, _ASKED)


def _totals(counts: np.ndarray) -> list[int]:
    """Occurrences, distinct ones, and how many have each count from 1 to GT_MAX + 1."""
    return [int(counts.sum()), int(np.count_nonzero(counts)), *(int(np.count_nonzero(counts == k)) for k in range(1, GT_MAX + 2))]


def _tell_words(asked: pa.Table, stored: pa.Table | None = None) -> pa.Table:
    """The counts and names of all words of a part; frequent words have small names."""
    if not asked.num_rows:
        return _TOLD.empty_table()
    part, own = asked.column("part")[0].as_py(), [unsqueezed(x, np.uint64, True) for x in asked.column("words").to_pylist()]
    kept = _told(stored, 1) if stored is not None else []
    before = [(unsqueezed(r["words"], np.uint64), unsqueezed(r["counts"], np.int64)) for r in kept]
    known, of = np.unique(np.concatenate([*own, *(w for w, _ in before)]), return_inverse=True)
    counts = np.concatenate([*([np.zeros(len(w), np.int64) for w in own] if before else (unsqueezed(x, np.int64) for x in asked.column("counts").to_pylist())), *(c for _, c in before)])
    total = np.bincount(of, counts, len(known)).astype(np.int64)
    order = np.lexsort((known, -total))
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    rows, at = [], 0
    for chunk, words in zip(asked.column("chunk").to_pylist(), own):
        mine = of[at : at + len(words)]
        rows.append({"level": 1, "part": part, "chunk": chunk, "counts": squeezed(total[mine]), "names": squeezed(name[mine])})
        at += len(words)
    if not before:
        seen = order[: np.count_nonzero(total)]
        rows.append({"level": 1, "part": part, "words": squeezed(known[seen]), "counts": squeezed(total[seen]), "totals": _totals(total)})
    return _rows(rows, _TOLD)


def _grouped(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, word) in order: keys, then of each pair its key's place, the first row with it, and of each row its pair."""
    keys, of_key = np.unique(key, return_inverse=True)
    width = int(word.max(initial=0)) + 1
    if len(keys) * width < 1 << 62:
        found, first, of = np.unique(of_key * width + word, return_index=True, return_inverse=True)
        return keys, found // width, first, of
    words, of_word = np.unique(word, return_inverse=True)
    found, first, of = np.unique(of_key * len(words) + of_word, return_index=True, return_inverse=True)
    return keys, found // len(words), first, of


def _tell(asked: pa.Table, level: int, last: bool, discounted: np.ndarray, stored: pa.Table | None = None) -> pa.Table:
    """The counts and names of a part's n-grams, and the sums of contexts; the last level needs no names. discounted are the counts 0 to GT_MAX of the level below."""
    if not asked.num_rows:
        return _TOLD.empty_table()
    part, lists = asked.column("part")[0].as_py(), asked.to_pydict()
    keys = [unsqueezed(x, np.int64, True) for x in lists["keys"]]
    runs = [unsqueezed(x, np.uint32).astype(np.int64) for x in lists["runs"]]
    key, word = [np.repeat(k, r) for k, r in zip(keys, runs)], [unsqueezed(x, np.int64) for x in lists["words"]]
    count, tail = [unsqueezed(x, np.int64) for x in lists["counts"]], [unsqueezed(x, np.int64) for x in lists["tails"]]
    kept = _told(stored, level) if stored is not None else []
    for r in kept:
        key.append(np.repeat(unsqueezed(r["keys"], np.int64, True), unsqueezed(r["runs"], np.uint32)))
        word.append(unsqueezed(r["words"], np.int64))
    if stored is not None:  # what is asked adds nothing to a model that is there
        count = [*(np.zeros_like(c) for c in count), *(unsqueezed(r["counts"], np.int64) for r in kept)]
        tail = [*tail, *(unsqueezed(r["names"], np.int64) for r in kept)]  # a stored row has tails for names
    key, word, count, tail = (np.concatenate(x) for x in (key, word, count, tail))
    contexts, context_of, first, of = _grouped(key, word)
    total = np.bincount(of, count, len(first)).astype(np.int64)
    seen = total > 0
    name = np.cumsum(seen) - seen
    r, c = total[seen], context_of[seen]
    sums = np.zeros((_SUMS, len(contexts)))
    for k in range(1, GT_MAX + 1):
        sums[k - 1] = np.bincount(c[r == k], minlength=len(contexts))
    sums[GT_MAX] = np.bincount(c, np.where(r > GT_MAX, r, 0), len(contexts))
    low = tail[first[seen]]
    sums[GT_MAX + 1] = np.bincount(c, np.where(low > GT_MAX, low, discounted[np.minimum(low, GT_MAX)]), len(contexts))
    whole = ~sums[:GT_MAX].any(0)
    rows, begin, pieces = [], 0, set()
    for chunk, own, run, split in zip(lists["chunk"], keys, runs, lists["split"]):
        split, size = unsqueezed(split, np.uint8) > 0, int(run.sum())
        answer = of[begin : begin + size]
        begin += size
        place = np.searchsorted(contexts, own)
        counts = total[answer]
        # The chunk needs the sums of contexts of which it has an unseen n-gram; those of split ones come by a join.
        wanted = place[~split & (np.minimum.reduceat(counts, np.cumsum(run) - run) == 0)]
        pieces.update(own[split].tolist())
        rows.append({"level": level, "part": part, "chunk": chunk, "counts": squeezed(counts), "names": None if last else squeezed(name[answer], True), "whole": squeezed(whole[place].astype(np.uint8)), "sums": squeezed(sums[:, wanted].reshape(-1)), "split_keys": sorted(set(own[split].tolist()))})
    pieces = sorted(pieces)
    told = {"level": level, "part": part, "split_keys": pieces, "split_sums": [sums[:, i].tolist() for i in np.searchsorted(contexts, pieces)]}
    if stored is None:
        begins = _begins(c)
        told |= {
            "keys": squeezed(contexts[c[begins]], True), "runs": squeezed(np.diff(np.append(begins, len(c))).astype(np.uint32)), "words": squeezed(word[first[seen]]), "counts": squeezed(r), "names": squeezed(low),
            "totals": _totals(total),
        }
    return _rows([*rows, told], _TOLD)


def good_turing(of: list[int]) -> np.ndarray:
    """Discount ratios of counts 1 to GT_MAX from the numbers of n-grams with counts 1 to GT_MAX + 1.

    Katz's formula where it gives ratios inside (0, 1); for the rest, as in small corpora,
    half a count is taken off.
    """
    k = len(of) - 1
    cut = (k + 1) * of[k] / of[0] if of[0] else 1.0
    out = []
    for r in range(1, k + 1):
        ratio = ((r + 1) * of[r] / (r * of[r - 1]) - cut) / (1 - cut) if of[r - 1] and cut < 1 else 0.0
        out.append(ratio if 0 < ratio < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted_counts(of: list[int]) -> np.ndarray:
    """The discounted counts of 0 to GT_MAX."""
    return np.concatenate(([0.0], good_turing(of) * np.arange(1, GT_MAX + 1)))


@dataclass(frozen=True)
class Totals:
    """Tokens and words of the training rows, what leaves the words' counts, and each level's discounted counts."""

    n: int
    v: int
    words_left: float
    words_divisor: float
    discounted: tuple[np.ndarray, ...]

    def with_words(self, of: list[int]) -> Totals:
        n, v, numbers = of[0], of[1], of[2:]
        discounted = discounted_counts(numbers)
        few = [numbers[k - 1] for k in range(1, GT_MAX + 1)]
        left = float(sum(m * (k - discounted[k]) for k, m in enumerate(few, 1)))
        # Without a discounted count one is added for other words, here as for other contexts.
        return Totals(n, v, left or 1.0, n if left else n + 1.0, (discounted,))

    def with_level(self, of: list[int]) -> Totals:
        return Totals(self.n, self.v, self.words_left, self.words_divisor, (*self.discounted, discounted_counts(of[2:])))


def _values(counts: np.ndarray, discounted: np.ndarray) -> np.ndarray:
    return np.where(counts > GT_MAX, counts, discounted[np.minimum(counts, GT_MAX)])


def _score(table: pa.Table, told: pa.Table, order: int, parts: int, split_at: int, totals: Totals) -> pa.Table:
    if not table.num_rows:
        return _SCORED.empty_table()
    chunk = _Chunk(table)
    words = lower = _first_level(chunk, told, parts)
    count = words.count[chunk.tokens]
    base = np.log10((count + 1) / (totals.n + totals.v + 1))
    by_word = np.where(words.count > 0, _values(words.count, totals.discounted[0]), totals.words_left / (totals.v + 1)) / totals.words_divisor
    p, divisor = by_word[chunk.tokens], np.full(len(chunk.tokens), totals.words_divisor, np.float64)
    n_known = count > 0
    for n in range(2, order + 1):
        e, answers, discounted = _entries(chunk, words, lower, n, parts, split_at), _told(told, n), totals.discounted[n - 1]
        lower = _next_level(chunk, e, answers, parts)
        if not len(e.at):
            continue
        sums = np.zeros((_SUMS, len(e.begins)))
        split = e.split[e.begins]
        wanted = ~split & (np.minimum.reduceat(lower.count, e.begins) == 0)
        sums[:, wanted] = np.concatenate([unsqueezed(r["sums"], np.float64).reshape(_SUMS, -1) for r in answers], 1)
        whole = np.concatenate([unsqueezed(r["whole"], np.uint8) for r in answers]) > 0
        if split.any():
            mine = {k: s for r in _told(told, n, True) for k, s in zip(r["split_keys"], r["split_sums"])}
            sums[:, split] = np.array([mine[k] for k in e.key[e.begins[split]].tolist()]).T
            whole[split] = ~sums[:GT_MAX, split].any(0)
        own = e.context_count + whole  # a context without a discounted count: one is added for other words
        mass = discounted[1:] @ sums[:GT_MAX] + sums[GT_MAX]
        context_of = (np.cumsum(np.bincount(e.begins, minlength=len(e.word))) - 1)[e.of]
        seen, below, own, mass = lower.count[e.of], divisor[e.at], own[context_of], mass[context_of]
        alpha = (1 - mass / own) / (1 - sums[GT_MAX + 1][context_of] / below)
        p[e.at] = np.where(seen > 0, _values(seen, discounted) / own, alpha * p[e.at])
        divisor[e.at] = own
    per = lambda x: np.add.reduceat(x, chunk.begins)
    return pa.table(
        {
            "doc_id": pa.array(chunk.ids, mask=chunk.no_id > 0), "held_out": pa.array(chunk.train_docs == 0), "n_tokens": pa.array(chunk.sizes),
            "n_known": pa.array(per(n_known.astype(np.int64))), "base_score": pa.array(per(base)), "score": pa.array(per(np.log10(p))),
        },
        schema=_SCORED,
    )


@dataclass(frozen=True)
class KatzModel:
    """A trained model: one Parquet table of its n-grams, a row for each level and part, and its totals.

    Rows of level 1 hold word hashes and counts, those of level n the contexts' keys, how
    many words follow each, these words' names, counts and the counts of their tails.
    """

    tables: DataFrame
    totals: Totals
    parts: int
    order: int
    split_at: int

    def score(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text) -> as score_documents; held_out is true."""
        return _run(docs, F.lit(False), self.order, self.split_at, self)[0]


def _with_splits(answers: DataFrame, kept: DataFrame, level: int) -> DataFrame:
    """Answers of a level, and to each chunk that asked for a split context a row with its summed pieces."""
    told = answers.select("level", "part", "chunk", "counts", "names", "whole", "sums")
    if level == 1:
        return told.withColumns({"split_keys": F.lit(None).cast("array<bigint>"), "split_sums": F.lit(None).cast("array<array<double>>")})
    pieces = kept.select(F.explode(F.arrays_zip("split_keys", "split_sums")).alias("s")).select("s.*")
    sums = pieces.groupBy("split_keys").agg(F.array(*[F.sum(F.get("split_sums", F.lit(i))) for i in range(_SUMS)]).alias("of"))
    wanted = answers.select("chunk", F.explode("split_keys").alias("split_keys")).distinct().join(sums, "split_keys")
    split = wanted.select(F.lit(level).cast("bigint").alias("level"), F.lit(-1).cast("bigint").alias("part"), "chunk", F.array("split_keys").alias("split_keys"), F.array("of").alias("split_sums"))
    return told.unionByName(split, allowMissingColumns=True)


def _run(docs: DataFrame, train: Column, order: int, split_at: int, model: KatzModel | None = None, chunk_bytes: int = CHUNK_BYTES, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, KatzModel]:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), train.alias("train"))
    chunks = staged(texts.mapInArrow(lambda batches: _chunks(batches, chunk_bytes), _ddl(_CHUNK)), "katz-chunks")
    size = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    few = shuffle_partitions(spark)
    parts = model.parts if model else max(2 * few, -(-size // part_tokens))
    places = max(few, -(-size // PARTITION_TOKENS))

    tokens = chunks.drop("words", "counts")

    def by(df: DataFrame, column: str):
        return df.repartition(places, column).groupBy(column)

    def asking(n: int):
        return lambda table, told: _ask(table, told, n, parts, split_at)

    def telling(n: int, lower: np.ndarray | None):
        if model:
            return lambda asked, stored: _tell(asked, n, n == order, lower, stored) if n > 1 else _tell_words(asked, stored)
        return lambda asked: _tell(asked, n, n == order, lower) if n > 1 else _tell_words(asked)

    told: DataFrame | None = None
    kept: list[DataFrame] = []
    totals = model.totals if model else None
    for n in range(1, order + 1):
        if n == 1:
            asked = chunks.select("chunk", "words", "counts").mapInArrow(lambda batches: _ask_words(batches, parts), _ddl(_ASKED))
        else:
            asked = by(tokens, "chunk").cogroup(by(told, "chunk")).applyInArrow(asking(n), _ddl(_ASKED))
        asked = by(asked, "part")
        if model:
            stored = model.tables.filter(F.col("level") == n)
            asked = asked.cogroup(by(stored, "part"))
        level = staged(asked.applyInArrow(telling(n, totals.discounted[n - 2] if n > 1 else None), _ddl(_TOLD)), f"katz-{n}")
        if not model:
            kept.append(level.filter("chunk IS NULL").drop("chunk"))
            of = kept[-1].agg(*[F.sum(F.get("totals", F.lit(i))) for i in range(GT_MAX + 3)]).first()
            of = [x or 0 for x in of]
            totals = Totals(0, 0, 1.0, 1.0, ()).with_words(of) if n == 1 else totals.with_level(of)
        answers = _with_splits(level.filter("chunk IS NOT NULL"), stored if model else kept[-1], n)
        told = answers if told is None else told.unionByName(answers)
    scored = by(tokens, "chunk").cogroup(by(told, "chunk")).applyInArrow(lambda t, u: _score(t, u, order, parts, split_at, totals), _ddl(_SCORED))
    out = scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out, model or KatzModel(reduce(DataFrame.unionByName, kept), totals, parts, order, split_at)


def fit(docs: DataFrame, train: Column, order: int = ORDER, split_at: int = SPLIT_AT) -> KatzModel:
    """The model of the rows of docs (doc_id, text) that train marks."""
    return _run(docs, train, order, split_at)[1]


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, split_at: int = SPLIT_AT, chunk_bytes: int = CHUNK_BYTES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train marks the rows to learn from. Scores are summed log10 probabilities; base_score is
    that of words by add-one counts. Null and empty texts are one end. Repeated rows all
    count, and rows without an id are scored too. Without training rows every word is unseen
    and scores are 0. Columns besides doc_id and text are unused.
    """
    return _run(docs, train, order, split_at, None, chunk_bytes, part_tokens)[0]


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, remainder(F.col("doc_id"), 7) != 2)
