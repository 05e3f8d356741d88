"""Token counts: a linear longest-match automaton with failure links and precomputed popped-token counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_START = "▁"


class Automaton:
    """Greedy longest-match piece counts of a word, one step a character.

    The trie holds the vocabulary and, for each character in it, that character alone; one that is no piece itself
    costs its UTF-8 bytes. `fail[v]` is the node of what is left after the longest pieces of v's string are popped
    and `popped[v]` how many pieces that was, so a word's count is read off without naming a piece. Characters that no
    piece holds cost their UTF-8 bytes.
    """

    def __init__(self, vocabulary):
        self.goto: dict[tuple[int, str], int] = {}
        cost, parents = [0], [(0, "")]

        def add(s: str) -> int:
            node = 0
            for c in s:
                child = self.goto.get((node, c))
                if child is None:
                    child = self.goto[node, c] = len(cost)
                    cost.append(0)
                    parents.append((node, c))
                node = child
            return node

        for piece in vocabulary:
            if piece:
                cost[add(piece)] = 1
        for c in {c for _, c in parents[1:]}:
            node = add(c)
            cost[node] = cost[node] or len(c.encode("utf-8", "replace"))
        depth = [0] * len(cost)
        for v in range(1, len(cost)):
            depth[v] = depth[parents[v][0]] + 1
        self.fail, self.popped = [0] * len(cost), [0] * len(cost)
        for v in sorted(range(1, len(cost)), key=depth.__getitem__):
            if cost[v]:
                self.popped[v] = cost[v]
                continue
            u, c = parents[v]
            z, n = self.fail[u], self.popped[u]
            while (z, c) not in self.goto:
                n, z = n + self.popped[z], self.fail[z]
            self.fail[v], self.popped[v] = self.goto[z, c], n

    def count(self, word: str) -> int:
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for c in word:
            while (node, c) not in goto:
                if not node:
                    n += len(c.encode("utf-8", "replace"))
                    break
                n, node = n + popped[node], fail[node]
            else:
                node = goto[node, c]
        while node:
            n, node = n + popped[node], fail[node]
        return n


class _Counts(dict):
    """Word -> pieces, kept for words seen lately."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(WORD_START + word)
        if len(word) <= 64:
            if len(self) >= 1 << 20:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes (longs) of every whole text: greedy pieces of each word with its start mark.

    Words are what white space separates. Null and empty texts count 0; repeated rows and rows without id are counted
    like any other. The automaton is sent to every executor: its size follows the vocabulary, not the documents.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))

    @F.pandas_udf("n_words long, n_tokens long, n_bytes long")
    def count(texts: pd.Series) -> pd.DataFrame:
        automaton = shipped.value
        counts = automaton.__dict__.setdefault("counts", _Counts(automaton))  # lives as long as the worker
        out = np.zeros((len(texts), 3), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = text.split()
                out[i] = len(words), sum(map(counts.__getitem__, words)), len(text.encode("utf-8", "replace"))
        return pd.DataFrame(out, columns=["n_words", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), count(F.col(text_col).cast("string")).alias("n"))
    return rows.select("doc_id", "n.*")
