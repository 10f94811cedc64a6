"""Unigram token counts of whole texts by a trie-shared dynamic program.

A pre-token is a longest run of characters other than white space, with the word mark in front. Its
token count is that of its best segmentation into vocabulary pieces, by the sum of the pieces' scores;
of equally good ones the one with the fewest tokens. A file of log probabilities is taken as it is; where it
holds merge ranks (scores 0, -1, -2 and so on), a piece's score is minus the log of its rank plus RANK_OFFSET,
a Zipf estimate of its log probability. A character may also be spelled in bytes, each a token with the score
BYTE_SCORE.

In each task a batch's new distinct pre-tokens go into a trie; one walk computes the forward score of
every node from its ancestors, once for all pre-tokens that share the prefix, and stores the count at
each pre-token's end. Counts stay known for later batches, MEMO of them at most; a text's count is the
sum over its pre-tokens. A pre-token of more than LONG_WORD characters shares little and would make the trie
deep: the same forward step runs over it by itself, in constant memory. Nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no tokens; repeated rows keep a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.shared import texts_of

MARK = "▁"
RANK_OFFSET = 10.0
BYTE_SCORE = -16.0
MEMO = 1_000_000
LONG_WORD = 4096


def default_file() -> str:
    """The piece vocabulary; its path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str, ranks: bool | None = None) -> dict[str, float]:
    """ranks: whether the file holds merge ranks; None: decided by its scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = range(model.get_piece_size())
    held = {
        model.id_to_piece(i): model.get_score(i)
        for i in pieces
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8
    }
    return log_scores(held) if (holds_ranks(held) if ranks is None else ranks) else held


def holds_ranks(scores: dict[str, float]) -> bool:
    """Whether the scores are whole numbers from 0 down, as merge ranks are."""
    return bool(scores) and all(score <= 0 and score == int(score) for score in scores.values())


def log_scores(ranks: dict[str, float]) -> dict[str, float]:
    return {piece: -math.log(RANK_OFFSET - rank) for piece, rank in ranks.items()}


class TrieCounter:
    def __init__(self, scores: dict[str, float]) -> None:
        #: The pieces' own trie; a node's score is under "".
        self.pieces: dict = {}
        for piece, score in scores.items():
            node = self.pieces
            for sign in piece:
                node = node.setdefault(sign, {})
            node[""] = score
        self.counts: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Store the counts of pre-tokens that are not known yet."""
        trie: dict = {}
        for word in words:
            node = trie
            for sign in MARK + word:
                node = node.setdefault(sign, {})
            node[""] = word
        best, count = [0.0], [0]
        walk = [(trie, 0, [])]
        pieces, counts = self.pieces, self.counts
        while walk:
            node, depth, open_pieces = walk.pop()
            starts = [*open_pieces, (pieces, depth)]
            if depth:
                # Set when its parent was left; siblings overwrite only this depth and below.
                best[depth:], count[depth:] = [node[0]], [node[1]]
                node = node[2]
            base, n_base = best[depth], count[depth]
            for sign, child in node.items():
                if not sign:
                    counts[child] = n_base
                    continue
                size = len(sign.encode())
                top, n_top = base + size * BYTE_SCORE, n_base + size
                going = []
                for piece, start in starts:
                    longer = piece.get(sign)
                    if longer is not None:
                        going.append((longer, start))
                        score = longer.get("")
                        if score is not None:
                            score += best[start]
                            if score > top or (score == top and count[start] + 1 < n_top):
                                top, n_top = score, count[start] + 1
                walk.append(((top, n_top, child), depth + 1, going))

    def count_alone(self, word: str) -> int:
        """The count of one pre-token by the same forward step, without a trie."""
        best, count, open_pieces = 0.0, 0, []
        for sign in MARK + word:
            size = len(sign.encode())
            top, n_top, going = best + size * BYTE_SCORE, count + size, []
            for piece, at, n_at in [*open_pieces, (self.pieces, best, count)]:
                longer = piece.get(sign)
                if longer is not None:
                    going.append((longer, at, n_at))
                    score = longer.get("")
                    if score is not None:
                        score += at
                        if score > top or (score == top and n_at + 1 < n_top):
                            top, n_top = score, n_at + 1
            best, count, open_pieces = top, n_top, going
        return count

    def totals(self, texts: list[list[str]]) -> list[int]:
        """The token counts of texts, given as their pre-tokens."""
        if len(self.counts) > MEMO:
            self.counts.clear()
        known, alone = self.counts, {}
        new = set().union(*texts).difference(known)
        for word in [w for w in new if len(w) > LONG_WORD]:
            new.remove(word)
            alone[word] = self.count_alone(word)
        self.learn(new)
        if not alone:
            return [sum(map(known.__getitem__, words)) for words in texts]
        return [sum(alone[w] if len(w) > LONG_WORD else known[w] for w in words) for words in texts]


_ready: dict[str, TrieCounter] = {}


def _counter(path: str) -> TrieCounter:
    if path not in _ready:
        _ready[path] = TrieCounter(piece_scores(path))
    return _ready[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_pretokens, n_tokens."""
    path = vocabulary or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [text.split() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(words) for words in texts], pa.int64()), pa.array(counter.totals(texts), pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"]
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
