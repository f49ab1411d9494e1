"""Lexical retrieval packing: documents that share rare terms end up in the same window.

1. Every text is tokenised once. Its ids go to the shared folder with its route: its two heaviest terms, by term
   frequency and by rank in the vocabulary, which is ordered by frequency. Each task adds its document frequencies.
2. Document frequencies are summed over all documents (a table no longer than the vocabulary).
3. Documents are range-partitioned by route and a hash of their id. The hash splits groups of copies and of
   look-alikes of any size, so no partition depends on how often a text repeats.
4. A task reads its partition in shards of about ``SHARD_TOKENS`` tokens. Each shard has an inverted index with BM25
   weights (global document frequencies and mean length). A seed document opens a window; the index ranks the unused
   documents of the shard against it, and they fill the window in that order. A document that does not fit is cut, and
   its rest seeds the next window. What is left over goes on into the next shard, so only a partition's last window is padded.

Defined results: a null or empty text is the end id alone. Rows are packed as they are: repeated rows and rows with a
null id are documents of their own. Equal scores keep the order of the shard. An empty table gives an empty table. Other
columns are ignored. A text of any length is cut into as many windows as it needs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import id_and_text

SHARD_TOKENS = 1 << 19
PARTITION_TOKENS = 1 << 22
K1, B = 1.2, 0.75

# Texts of these characters are split alike by both tokenizer libraries; all others go to the slower one.
_ORDINARY = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ſ]*")
# Where no white space stands beside white space, these last branches of a pattern match one character, as plain \s does without looking ahead.
_AHEAD = r"|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level vocabulary: the tokenizer, and the same merges as ranks with their split pattern."""

    tokenizer_path: str
    ranks_path: str | None = None
    pattern: str | None = None
    size: int = 50257

    @property
    def id_type(self) -> str:
        """Little-endian type of stored ids; the end id is one of the vocabulary's."""
        return "<u2" if self.size <= 1 << 16 else "<u4"


@cache  # one of each per Python worker, not per task
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _plain(text: str) -> bool:
    """Whether both libraries split the text alike; most texts are told by two quick scans."""
    return "<|" not in text and (text.isascii() and text.replace("\n", "").isprintable() or _ORDINARY.fullmatch(text) is not None)


def _parted(text: str) -> bool:
    """Whether no white space stands beside white space in a text that is ``_plain``: it has spaces and line breaks only."""
    return "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text


def encoder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    def exact(text: str) -> list[int]:
        return _exact(vocabulary.tokenizer_path).encode(text, add_special_tokens=False).ids

    if not vocabulary.ranks_path:
        return exact
    fast = _fast(vocabulary.ranks_path, vocabulary.pattern)
    return lambda text: fast.encode_ordinary(text) if _plain(text) else exact(text)


def array_encoder(vocabulary: Vocabulary, end_id: int) -> Callable[[str], np.ndarray]:
    """Ids and end id of a text as an array of the stored type; the fast library hands over arrays, not lists."""
    encode, kind = encoder(vocabulary), vocabulary.id_type
    fast = _fast(vocabulary.ranks_path, vocabulary.pattern) if vocabulary.ranks_path else None
    faster = fast
    if fast is not None and vocabulary.pattern.endswith(_AHEAD):
        faster = _fast(vocabulary.ranks_path, vocabulary.pattern.removesuffix(_AHEAD) + r"|\s")

    def ids(text: str) -> np.ndarray:
        if fast is not None and _plain(text):
            found = (faster if _parted(text) else fast).encode_to_numpy(text, disallowed_special=())
        else:
            found = np.array(encode(text), np.uint32)
        out = np.empty(len(found) + 1, kind)
        out[:-1], out[-1] = found, end_id
        return out

    return ids


@dataclass
class Terms:
    """Distinct ids of several documents (without their end), with counts: entries ``start[d]`` to ``start[d + 1]`` are document d's."""

    owner: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Terms:
        """One sort for all: document and id share a number, 32 bits wide where they fit."""
        sizes = [len(d) - 1 for d in documents]
        flat = np.concatenate([d[:-1] for d in documents]) if documents else np.zeros(0, np.uint16)
        narrow = flat.dtype.itemsize == 2 and len(documents) < 1 << 16
        kind, bits = (np.uint32, 16) if narrow else (np.uint64, 32)
        key = (np.repeat(np.arange(len(documents), dtype=kind), sizes) << kind(bits)) | flat
        key.sort()
        first = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate([[0], first]) if len(key) else first
        distinct = key[first]
        owner = (distinct >> kind(bits)).astype(np.int64)
        return cls(owner, (distinct & kind((1 << bits) - 1)).astype(np.int64), np.diff(first, append=len(key)), np.searchsorted(owner, np.arange(len(documents) + 1)))

    def of_document(self, d: int) -> slice:
        return slice(self.start[d], self.start[d + 1])


def _routes(terms: Terms, ranks: np.ndarray) -> np.ndarray:
    """Per document the two terms (-1 where there are fewer) that weigh most by frequency here and rank in the vocabulary.

    ``ranks`` has the weight of each id's rank. Equal weights go to the smaller id.
    """
    sizes = np.diff(terms.start)
    out, used = np.full((len(sizes), 2), -1, np.int32), np.flatnonzero(sizes)
    if not len(used):
        return out
    weight = terms.tf / (terms.tf + K1) * ranks[terms.term]
    for k in range(2):
        best = np.maximum.reduceat(weight, terms.start[used])
        at = np.flatnonzero(weight == np.repeat(best, sizes[used]))
        own = terms.owner[at]
        first = at[np.concatenate([[True], own[1:] != own[:-1]])]
        some = best >= 0
        out[used[some], k] = terms.term[first[some]]
        weight[first] = -1
    return out


def tokenised(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 1) -> DataFrame:
    """doc_id, ids with the end id, n of them, route, route2; and one row per task that only has df: term ids and their document counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, df = array_encoder(vocabulary, end_id), np.zeros(vocabulary.size, np.int64)
        ranks = np.log1p(np.arange(vocabulary.size))
        for batch in batches:
            documents = [encode(text) for text in batch["text"]]
            terms = Terms.of(documents)
            df += np.bincount(terms.term, minlength=vocabulary.size)
            routes = _routes(terms, ranks)
            out = pd.DataFrame({"ids": [d.tobytes() for d in documents], "n": [len(d) for d in documents], "route": routes[:, 0], "route2": routes[:, 1]})
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), df=None)[["doc_id", "ids", "n", "route", "route2", "df"]]
        used = np.flatnonzero(df)
        yield pd.DataFrame({"doc_id": [None], "ids": [None], "n": [0], "route": [-1], "route2": [-1], "df": [np.stack([used, df[used]]).tobytes()]}).astype({"doc_id": "Int64"})

    return docs.mapInPandas(scan, "doc_id long, ids binary, n long, route int, route2 int, df binary")


@dataclass
class Corpus:
    """Statistics over all documents; ``df`` has one count for each id of the vocabulary."""

    documents: int
    mean_length: float
    df: np.ndarray
    id_type: str

    def idf(self) -> np.ndarray:
        return np.log1p((self.documents - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)


def corpus_statistics(tokens: DataFrame, vocabulary: Vocabulary) -> Corpus:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(vocabulary.size, np.int64)
        for batch in batches:
            for raw in batch["df"]:
                terms, n = np.frombuffer(raw, np.int64).reshape(2, -1)
                df[terms] += n
        used = np.flatnonzero(df)
        yield pd.DataFrame({"term": used, "df": df[used]})

    total = tokens.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("n")).first()
    rows = tokens.filter("df is not null").select("df").mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(vocabulary.size, np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return Corpus(total["documents"], (total["n"] or 0) / max(1, total["documents"]), df, vocabulary.id_type)


class Index:
    """Inverted index of one shard: for each term, the documents that hold it and their BM25 weights."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus, idf: np.ndarray) -> None:
        self.terms = Terms.of(documents)
        t, length = self.terms, np.array([len(d) for d in documents])
        scale = K1 * (1 - B + B * length / max(corpus.mean_length, 1e-9))
        weight = (idf[t.term] * (t.tf * (K1 + 1) / (t.tf + scale[t.owner]))).astype(np.float32)
        order = np.argsort(t.term.astype(np.uint16) if corpus.id_type == "<u2" else t.term, kind="stable")
        self.size, self.owner, self.weight = len(documents), t.owner[order], weight[order]
        self.vocabulary, self.start = np.unique(t.term[order], return_index=True)
        self.start = np.append(self.start, len(order))

    def keep(self, documents: np.ndarray) -> None:
        """Drop the postings of documents that are not in this mask; the others score as before."""
        kept = documents[self.owner]
        self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
        self.owner, self.weight = self.owner[kept], self.weight[kept]

    def scores(self, document: int) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, self.terms.term[self.terms.of_document(document)])
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(self.size)
        postings = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return np.bincount(self.owner[postings], self.weight[postings], self.size)


@dataclass
class Packer:
    """Windows of one task. ``open`` holds the pieces of the window that is not full yet."""

    window: int
    next_id: int
    corpus: Corpus
    idf: np.ndarray
    fill: int = 0
    rows: list[tuple] = field(default_factory=list)

    def _pour(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            size = min(len(ids) - start, self.window - self.fill)
            self.rows.append((doc_id, start, size, len(ids), self.next_id, self.fill, ids[start:start + size].astype("<u4").tobytes()))
            start, self.fill = start + size, self.fill + size
            if self.fill == self.window:
                self.next_id, self.fill = self.next_id + 1, 0

    def shard(self, documents: list[tuple[int | None, np.ndarray]]) -> None:
        index = Index([ids for _, ids in documents], self.corpus, self.idf)
        unused = np.ones(len(documents), bool)
        first, indexed = 0, len(documents)
        seed: int | None = None
        while True:
            if seed is None:
                while first < len(documents) and not unused[first]:
                    first += 1
                if first == len(documents):
                    return
                seed = first
                unused[seed] = False
                self._pour(*documents[seed])
            if self.fill == 0:
                seed = None
                continue
            rest = np.flatnonzero(unused)
            if not len(rest):
                return
            if len(rest) <= 0.75 * indexed:
                index.keep(unused)
                indexed = len(rest)
            scores = index.scores(seed)[rest]
            window, seed = self.next_id, None
            for i in rest[np.argsort(-scores, kind="stable")]:
                unused[i] = False
                self._pour(*documents[i])
                if self.next_id != window:
                    seed = int(i) if self.fill else None  # its rest opens the next window
                    break


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each)."""
    tokens = cut_lineage(tokenised(id_and_text(docs, id_col, text_col), vocabulary, end_id), "packing-ids")
    corpus = corpus_statistics(tokens, vocabulary)
    parts = max(1, round(corpus.documents * corpus.mean_length / PARTITION_TOKENS))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(window, TaskContext.get().partitionId() << 32, corpus, corpus.idf())
        shard: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def out() -> pd.DataFrame:
            packer.shard(shard)
            shard.clear()
            rows = pd.DataFrame(packer.rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            packer.rows = []
            return rows.astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].astype("Int64"), batch["ids"], strict=True):
                ids = np.frombuffer(raw, corpus.id_type)
                shard.append((None if doc_id is pd.NA else int(doc_id), ids))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield out()
                    size = 0
        if shard:
            yield out()

    dealt = tokens.filter("df is null").select("doc_id", "ids", "n", "route", "route2").repartitionByRange(parts, "route", "route2", F.xxhash64("doc_id", "n"))
    # The order is total but for equal rows, so a task that is run again packs alike.
    return dealt.sortWithinPartitions("route", "route2", F.xxhash64("doc_id", "n"), "doc_id", "n", "ids").select("doc_id", "ids").mapInPandas(fill, _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
