"""Token counts of a unigram tokenizer, without its tokens: Viterbi over the vocabulary matches of each word.

The text is split at Unicode white space; each word gets the mark U+2581 in front and is segmented by itself, as
unigram tokenizers with such a pre-tokenizer do. An Aho-Corasick automaton names every vocabulary piece that ends
at each place of a word; per place the best score, the number of pieces and whether the last is unknown go on.

Exact rules: a piece replaces what ends at the same place only if its score is strictly greater, starts going from
left to right, so the longest of equals stays; where no one-character piece starts at a place, an unknown piece of
one character does, with the least score of the vocabulary less 10, compared after the pieces that start there;
unknown pieces in a row count as one (`fuse_unk`).

The vocabulary, pairs of piece and score, is a parameter. pieces_of() makes one from a SentencePiece file, whose path is
a parameter too: a unigram file's pieces with the file's own scores; a file of another kind states an order of merges and
no probabilities, so that its pieces get the scores of a Zipf law of their place. Nothing is trained.

Plan: one scan of the texts, no shuffle. The vocabulary is broadcast (its size is checked); each worker keeps the
counts of the words of up to CACHE_LENGTH characters that it has seen in a dictionary that starts anew at CACHE_WORDS,
as most words recur. The recursion looks back by the longest piece only, so a word's memory is the word itself.

Defined cases: null, empty and blank texts have 0 tokens; a null id passes; texts and words of any length are counted
whole; repeated rows get a row each; an empty table gives an empty result; other columns, whatever their names, are
unread.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import each_text, field, scan_texts

MARK, UNKNOWN_PENALTY = "▁", 10.0
CACHE_WORDS, CACHE_LENGTH, MAX_PIECES = 300_000, 64, 2_000_000
#: A word's tokens and unknown tokens in one number: sums of them are sums of both.
SHIFT = 40
#: Where a SentencePiece file names its kind (trainer's field, kind's field), and the number of the unigram kind.
TRAINER_FIELD, KIND_FIELD, UNIGRAM = 2, 3, 1


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A protocol buffer's number, and the place after it."""
    value, shift = 0, 0
    while True:
        value, shift, more, at = value | (data[at] & 127) << shift, shift + 7, data[at] > 127, at + 1
        if not more:
            return value, at


def fields(data: bytes):
    """(field, value) of a protocol buffer message: numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def is_unigram(model: bytes) -> bool:
    """Whether a SentencePiece file holds a unigram model, which is the kind of a file that names none."""
    kinds = [v for f, trainer in fields(model) if f == TRAINER_FIELD for g, v in fields(trainer) if g == KIND_FIELD]
    return (kinds or [UNIGRAM])[-1] == UNIGRAM


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a SentencePiece file in its order, with its scores if it is a unigram model; else the r-th of n has score -ln(r + 1) - ln(H), H the sum of 1 / (r + 1)."""
    import sentencepiece

    with open(model_file, "rb") as file:
        data = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    if is_unigram(data):
        return [(model.id_to_piece(i), model.get_score(i)) for i in ids]
    whole = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return [(model.id_to_piece(i), -math.log(r + 1) - whole) for r, i in enumerate(ids)]


class Counts(dict):
    """word -> tokens + unknown tokens << SHIFT, filled in as words are asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], fuse_unk: bool = True, most: int = CACHE_WORDS):
        import ahocorasick

        super().__init__()
        self.automaton, self.fuse, self.most = ahocorasick.Automaton(), fuse_unk, most
        known: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                known.setdefault(piece, score)
        for piece, score in known.items():
            self.automaton.add_word(piece, (len(piece), score))
        if known:
            self.automaton.make_automaton()
        self.single = {p for p in known if len(p) == 1}
        self.longest = max(map(len, known), default=1)
        self.unknown = min(known.values(), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        tokens, unknown = self.count(MARK + word)
        out = tokens + (unknown << SHIFT)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, unknown tokens): what is known of the last `longest` places goes round in rings."""
        size, single, unknown, fuse = self.longest + 1, self.single, self.unknown, self.fuse
        best, pieces, unknowns, open_unknown = [0.0] * size, [0] * size, [0] * size, [False] * size
        matches = iter(self.automaton.iter(word)) if self.single or len(self.automaton) else iter(())
        end, match = -1, next(matches, None)
        for end, c in enumerate(word):
            top, start, new = -math.inf, 0, False
            while match is not None and match[0] == end:  # longest first: its start is the leftmost
                length, score = match[1]
                at = (end + 1 - length) % size
                if best[at] + score > top:
                    top, start = best[at] + score, at
                match = next(matches, None)
            if c not in single and best[end % size] + unknown > top:
                start, new = end % size, True
                top = best[start] + unknown
            here = (end + 1) % size
            fused = new and fuse and open_unknown[start]
            best[here], pieces[here] = top, pieces[start] + (not fused)
            unknowns[here], open_unknown[here] = unknowns[start] + (new and not fused), new
        return pieces[(end + 1) % size], unknowns[(end + 1) % size]

    def of_text(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown tokens)."""
        words = text.split()
        both = sum(map(self.__getitem__, words))
        return len(words), both & ((1 << SHIFT) - 1), both >> SHIFT


def counted(docs: DataFrame, vocabulary: list[tuple[str, float]], keep: list[str], *, text_col: str = "text", fuse_unk: bool = True, max_pieces: int = MAX_PIECES) -> DataFrame:
    """The `keep` columns, then n_words, n_tokens and n_unknown under the ADDED prefix."""
    if len(vocabulary) > max_pieces:
        raise ValueError(f"a vocabulary of {len(vocabulary)} pieces is more than the {max_pieces} that are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counts = Counts(shared.value, fuse_unk)

        def kernel(col: pa.Array) -> list[pa.Array]:
            rows = [counts.of_text(t.decode()) for t in each_text(col)]
            return [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]

        return kernel

    return scan_texts(docs, text_col, keep, [field(n, "long") for n in ("n_words", "n_tokens", "n_unknown")], make)
