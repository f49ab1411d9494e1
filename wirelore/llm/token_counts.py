"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists all vocabulary matches of a word by end position, longest first. The dynamic
program over end positions carries the best score and the number of pieces on that path. Ties follow the tokenizer:
it visits start positions in ascending order and replaces a path only by a strictly better one, so of equal paths
the one whose last piece starts first stays. A character that no single-character piece covers costs the lowest
score minus ten; runs of such characters are one unknown piece, or one piece per UTF-8 byte with byte fallback.

The text is split before each word mark (a space), as the tokenizer does, so a word's count does not depend on its
surroundings and is remembered per task (``MEMO`` words at most, then forgotten).

Defined results: a null or empty text has zero tokens; rows are independent, so repeated rows come back repeated and
an empty table gives an empty table; a null id is kept; other columns are ignored. Long texts are counted whole, word by word; a
word without spaces, however long, takes time in proportion to its length times the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .tables import id_and_text

MARK = "▁"
MEMO = 400_000
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # positions up to here are final

        def step(position: int, have: bool) -> None:
            """Close ``position``: the single-character fallback comes last, as its start is the latest."""
            before, score = position - 1, best[position - 1] + self.unknown
            if not have or score > best[position]:
                best[position], unknown[position] = score, True
                # Neighbouring unknown characters share a piece unless they fall back to bytes.
                extra = len(word[before].encode("utf-8", "surrogatepass")) if self.bytes else 0 if unknown[before] else 1
                count[position] = count[before] + extra

        have = single = False
        for last, (length, score) in self.matches.iter(word):
            end = last + 1
            while done + 1 < end:  # closes every position before this end
                if not single:
                    step(done + 1, have)
                done, have, single = done + 1, False, False
            score += best[end - length]
            if not have or score > best[end]:
                best[end], count[end], have = score, count[end - length] + 1, True
            single = single or length == 1
        while done < n:
            if not single:
                step(done + 1, have)
            done, have, single = done + 1, False, False
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        # Every mark starts a word; a text without one at its start gets one.
        words = words[1:] if words[0] == "" else words
        memo, total = self.memo, 0
        for w in words:
            c = memo.get(w)
            if c is None:
                if len(memo) >= MEMO:
                    memo.clear()
                c = memo[w] = self.word(MARK + w)
            total += c
        return total


def count_tokens(docs: DataFrame, vocabulary: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_chars for every row. ``vocabulary`` is a model file that every executor can read."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(read_vocabulary(vocabulary), byte_fallback)
        for batch in batches:
            texts = batch["text"]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [counter.text(t) for t in texts], "n_chars": texts.str.len()})

    return id_and_text(docs, id_col, text_col).mapInPandas(scan, "doc_id long, n_tokens long, n_chars long")
