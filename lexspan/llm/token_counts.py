"""Operator 10: unigram token counts by trie-shared dynamic programming.

Scores: one pass over all texts counts how often each token of the vocabulary occurs when the distinct words of a chunk are cut by the
vocabulary's own merges; a token's score is the logarithm of its share, with one added to every count.

Segmentation: distinct pre-tokens are dealt to buckets by their first signs, so that words with a common prefix meet, and each is
solved once for the whole table.  A bucket inserts its words in a trie.  A node holds the state of an automaton over the vocabulary,
which lists the tokens that end there, and from these the best forward score of its prefix and the number of tokens of that
segmentation; words that share the prefix reuse the node.  The number at a word's last node is its terminal count.
The counts go back to the chunks that hold the words and are summed by text.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _PIECES_ARROW, CHUNK, KNOWN, _encoder, _pack, cut_texts, deal_words, home_by_prefix, read_ranks, whole_chunks, words_of
from .common import row_windows, utf8_column

NODES = 600_000  # nodes of a trie at which a bucket begins a new one
LONG = 512  # bytes from which a word passes the automaton without entering the trie


def unigram_scores(ranks: dict[bytes, int], counts: dict[int, int]) -> dict[bytes, float]:
    """Log-probabilities of the tokens from their numbers of occurrences (by rank), one added to each."""
    total = math.log(sum(counts.values()) + len(ranks))
    return {token: math.log(counts.get(rank, 0) + 1) - total for token, rank in ranks.items()}


class Automaton:
    """Reads bytes; a state knows the scored tokens that are suffixes of what was read, as (length, score), shortest first."""

    def __init__(self, scores: dict[bytes, float]):
        self.next: dict[int, int] = {}  # state * 256 + byte -> state, for prefixes of tokens; filled up by step
        depth, own, parent = [0], [None], [(0, 0)]
        for token, score in scores.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                at = self.next.get(key)
                if at is None:
                    at = self.next[key] = len(depth)
                    depth.append(depth[state] + 1), own.append(None), parent.append((state, byte))
                state = at
            own[state] = (len(token), score)
        self.own, self.parent = own, parent
        self.shorter: dict[int, int] = {0: 0}
        self.found: dict[int, list[tuple[int, float]]] = {0: []}

    def suffix(self, state: int) -> int:
        """The state of the longest proper suffix that begins a token."""
        chain = []
        while state not in self.shorter:
            chain.append(state)
            state = self.parent[state][0]
        for at in reversed(chain):
            before, byte = self.parent[at]
            self.shorter[at] = self.step(self.shorter[before], byte) if before else 0
        return self.shorter[chain[0]] if chain else self.shorter[state]

    def step(self, state: int, byte: int) -> int:
        at = state
        while (to := self.next.get(at << 8 | byte)) is None:
            if not at:
                to = 0
                break
            at = self.suffix(at)
        if at != state or not to:
            self.next[state << 8 | byte] = to
        return to

    def ending(self, state: int) -> list[tuple[int, float]]:
        got = self.found.get(state)
        if got is None:
            got = list(self.ending(self.suffix(state)))
            if self.own[state]:
                got.append(self.own[state])
            self.found[state] = got
        return got


class PreTokenTrie:
    """Distinct words with shared prefixes; count(word) is the number of tokens of its best segmentation, of equal scores the one
    with fewer tokens."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.state, self.best, self.tokens = [0], [0.0], [0]

    def _solve(self, state: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Forward score and count of a prefix, from those of all shorter ones."""
        top, least, n = -math.inf, 0, len(best)
        for length, score in self.automaton.ending(state):
            score += best[n - length]
            if score >= top:
                count = tokens[n - length] + 1
                if score > top or count < least:
                    top, least = score, count
        return top, least

    def count(self, word: bytes) -> int:
        if len(word) >= LONG:
            return self._count_long(word)
        node, best, tokens = 0, [0.0], [0]
        for byte in word:
            key = node << 8 | byte
            at = self.child.get(key)
            if at is None:
                state = self.automaton.step(self.state[node], byte)
                top, least = self._solve(state, best, tokens)
                at = self.child[key] = len(self.state)
                self.state.append(state), self.best.append(top), self.tokens.append(least)
            best.append(self.best[at]), tokens.append(self.tokens[at])
            node = at
        return self.tokens[node]

    def _count_long(self, word: bytes) -> int:
        state, best, tokens = 0, [0.0], [0]
        for byte in word:
            state = self.automaton.step(state, byte)
            top, least = self._solve(state, best, tokens)
            best.append(top), tokens.append(least)
        return tokens[-1]

    def __len__(self) -> int:
        return len(self.state)


def _tally(path: str):
    """(text) -> a row (token, n) for each token that occurs in a task's texts."""

    def run(batches):
        encode, known, total = _encoder(path), {}, np.zeros(len(read_ranks(path)) + 1, np.int64)
        for batch in batches:
            offsets, data, _ = utf8_column(batch.column(0))
            for a, b in row_windows(offsets, CHUNK):
                text, _, starts, ends, hashes, _ = cut_texts(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                _, first, often = np.unique(hashes, return_index=True, return_counts=True)
                if len(known) > KNOWN:
                    known.clear()
                ids, reps = [], []
                for x, y, n in zip(starts[first].tolist(), ends[first].tolist(), often.tolist()):
                    word = text[x:y]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word.encode())
                    ids += got
                    reps += [n] * len(got)
                if ids:
                    found, which = np.unique(np.array(ids, np.int64), return_inverse=True)
                    if found[-1] >= len(total):
                        total = np.concatenate([total, np.zeros(int(found[-1]) + 1 - len(total), np.int64)])
                    total[found] += np.bincount(which, np.array(reps, float)).astype(np.int64)
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], names=["token", "n"])

    return run


def token_frequencies(docs: DataFrame, ranks_path: str) -> dict[int, int]:
    """Occurrences of each token over all texts; at most as many entries as the vocabulary has."""
    rows = docs.select("text").where("text is not null").mapInArrow(_tally(ranks_path), "token long, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


@lru_cache(maxsize=1)
def _automaton(path: str, counts: tuple[tuple[int, int], ...]) -> Automaton:
    return Automaton(unigram_scores(read_ranks(path), dict(counts)))


def _solve_words(path: str, counts: tuple[tuple[int, int], ...]):
    def run(batches):
        trie, now, known = PreTokenTrie(_automaton(path, counts)), None, {}
        for batch in batches:
            bucket, found = batch.column(1).to_pylist(), []
            for b, lengths, data in zip(bucket, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != now or len(trie) > NODES or len(known) > KNOWN:
                    now, known = b, {}
                    trie.clear()
                own = []
                for word in words_of(lengths, data):
                    n = known.get(word)
                    if n is None:
                        n = known[word] = trie.count(word)
                        if len(trie) > NODES:
                            trie.clear()
                    own.append(n)
                found.append(_pack(np.array(own, np.int64), 4))
            n = len(bucket)
            none = _pack(np.zeros(0, np.int64), 3)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0).cast(pa.int64()), pa.array(bucket, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.array(found, pa.binary()), pa.array([none] * n, pa.binary())], schema=_PIECES_ARROW)

    return run


def _sum_by_text(batches):
    for ids, ends, words, parts, order in whole_chunks(batches):
        count = np.empty(len(order), np.int64)
        count[order] = np.concatenate([c for c, _ in parts.values()]) if parts else []
        upto = np.concatenate([[0], np.cumsum(count[words])])[ends]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(ends)), pa.array(np.diff(upto))], names=["doc_id", "n_pretokens", "n_tokens"])


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_pretokens, n_tokens; a row for each row.

    Null and empty texts have 0 of both.  Every byte is a token of the vocabulary, so every text has a segmentation.
    Texts are read three times, once for the scores, so docs must be a table or another input that reads the same again.  What the
    driver gets is one number for each token of the vocabulary.  A text stays whole in one chunk of its own if it is longer than CHUNK.
    Null and repeated doc_ids keep a row each; other columns aren't read.  No rows: no rows.
    """
    counts = tuple(sorted(token_frequencies(docs, ranks_path).items()))
    return deal_words(docs, _solve_words(ranks_path, counts), _sum_by_text, "doc_id long, n_pretokens long, n_tokens long", home_by_prefix)
